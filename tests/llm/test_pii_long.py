"""Texts with very many matches: spans and masks equal a plain loop, in time that is linear in the text."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from utterlake.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def crowded(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["é" * rng.randint(1, 9), "日本", "𝒳y", f"u{i}@h{i}.example.org", f"10.0.{i % 300}.7", f"+1 743 555 {1000 + i % 9000}"]) for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_running(spark, n):
    rng = random.Random(n)
    values = [rng.randint(0, 99) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, tops = df.select(pii.running(F.col("v"), lambda a, x: a + x), pii.running(F.col("v"), lambda a, x: F.greatest(a, x))).first()
    assert sums == [sum(values[:i]) for i in range(n)] and tops == [max(values[:i], default=0) for i in range(n)]


def test_between(spark):
    text = crowded(900, 1)
    cuts = [(0, 0), (0, 1), (1023, 1024), (1023, 1025), (1024, 1024), (5, 3000), (len(text) - 1, len(text) + 40), (len(text), len(text) + 40)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    got = df.select(pii.between(pii.pieces(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [text[a:b] for a, b in cuts]


def test_crowded_texts(spark):
    texts = [crowded(2000, seed) for seed in range(3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    masked = {r.doc_id: r.text for r in pii.mask_pii(d).collect()}
    for r in pii.find_pii(d).collect():
        t = texts[r.doc_id]
        assert [(s.start, s.end) for s in r.pii_email] == [m.span() for m in re.finditer(EMAIL, t)]
        spans = sorted((s.start, -s.end, s.kind) for k in pii.KINDS for s in r[f"pii_{k.name}"])
        for s in (s for k in pii.KINDS for s in r[f"pii_{k.name}"]):
            kind = next(k for k in pii.KINDS if k.name == s.kind)
            near = t[max(s.start - 40, 0) : s.start] + " " + t[s.end : s.end + 40]
            assert s.score == min(1.0, kind.score + (0.2 if re.search(kind.context, near.lower()) else 0.0))
        out, at = "", 0
        for start, less, kind in spans:
            if start >= at:
                out += t[at:start] + f"[{kind.upper()}]"
            at = max(at, -less)
        assert masked[r.doc_id] == out + t[at:]


def test_time_is_linear(spark):
    """Eight times the text and its matches take far less than 64 times as long."""

    def seconds(n):
        d = spark.createDataFrame([(1, crowded(n, 9))], "doc_id int, text string").cache()
        d.count()
        begun = time.monotonic()
        assert len(pii.mask_pii(d).first().text) > n
        return time.monotonic() - begun

    seconds(1000)
    assert seconds(160_000) < 24 * max(seconds(20_000), 0.5)
