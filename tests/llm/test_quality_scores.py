"""The registered quality query's scores against a plain loop over words, and its bound on an id that many rows share."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm import quality
from utterlake.llm.jaccard_join import word_hashes
from utterlake.llm.ngrams import FOLD


def plain(model, text):
    """expected grade, tail and selected, word by word."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", FOLD[np.frombuffer(raw, np.uint8)].tobytes())

    def score(weights):
        weights, z = weights.astype(float), 0.0
        slots = Counter(int(word_hashes(np.frombuffer(w, np.uint8))[1][0]) >> (64 - quality.BITS) for w in words)
        for slot, n in slots.items():
            z += weights[slot] * math.log1p(n)
        for byte, n in Counter(raw).items():
            z += 4 * weights[(1 << quality.BITS) + byte] * math.sqrt(n / len(raw))
        kinds = len(slots) / max(len(words), 1)
        return z + 4 * (weights[(1 << quality.BITS) + 256] * kinds + weights[(1 << quality.BITS) + 257] * (1 - kinds))

    z = score(model.weights)
    above = [1 - 1 / (1 + math.exp(-(t - z))) for t in model.thresholds]
    bad = 1 / (1 + math.exp(-(model.toxic.thresholds[0] - score(model.toxic.weights)))) if model.toxic else 0.0
    return sum(above), above[1], above[1] >= 0.2 and bad <= model.most_toxic


def test_registered_scores(spark, sf, monkeypatch):
    seen, real = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    got = {r.doc_id: r for r in quality.op2_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(texts) and len(seen) == 1 and len(seen[0].thresholds) == 2
    for i, text in texts.items():
        grade, tail, selected = plain(seen[0], text)
        assert got[i].expected_grade == pytest.approx(grade, rel=1e-6, abs=1e-9) and got[i].tail == pytest.approx(tail, rel=1e-6, abs=1e-9)
        assert got[i].selected == selected or abs(tail - 0.2) < 1e-6


def test_the_bound_holds_for_rows_of_one_key(spark):
    """A third of the rows share a key; texts part them."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("key"), F.concat(F.lit("w"), "id").alias("text"), F.lit(1).alias("grade"))
    sample = quality.bounded(rows, 3000, 300, 3)
    assert 200 < sample.count() < 400 and 60 < sample.where("key = 7").count() < 140
