"""Language identification rejects unseen scripts and gibberish and keeps clean texts."""

from __future__ import annotations

import base64
import random

from pyspark.sql import functions as F

from utterlake.llm import language_id

LETTERS = {"cyrillic": (0x430, 32), "greek": (0x3B1, 24), "arabic": (0x627, 28), "devanagari": (0x905, 50), "cjk": (0x4E00, 3000), "ascii": (0x61, 26)}


def test_unseen_scripts_and_gibberish_are_rejected(spark):
    rng, odd = random.Random(7), []
    letters = {k: [chr(a + i) for i in range(n)] for k, (a, n) in LETTERS.items()} | {"consonants": list("bcdfghjklmnpqrstvwxz")}
    for words in (20, 50, 500):
        for kind, of in letters.items():
            odd += [(kind, words, " ".join("".join(rng.choices(of, k=rng.randint(3, 9))) for _ in range(words))) for _ in range(10)]
        odd += [("base64", words, base64.b64encode(rng.randbytes(5 * words)).decode()) for _ in range(10)]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    assert [r for r in language_id.predict(spark.createDataFrame(odd, "kind string, words int, text string"), model).where("not rejected").select("kind", "words").collect()] == []
    clean = language_id.predict(docs.where(held & F.col("text").rlike("\\p{L}")), model)
    n, lost = clean.agg(F.count(F.lit(1)), F.count_if("rejected")).first()
    assert n > 3000 and lost <= 0.002 * n
