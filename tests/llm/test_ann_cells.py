"""Nearest neighbours: rows without an id, a vector that a third of all rows hold, lists divided by second-level centroids, dealt queries."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=10):
    """For each query row, as a sorted list of results: (query_id, [(score, vec_id)])."""
    x = np.array([v for _, v in rows], float)
    out = []
    for i, (q, v) in enumerate(rows):
        if q is not None and q % 100 == 0:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
            order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (d[j], rows[j][0] is None, rows[j][0] or 0))[:k]
            out.append((q, [(round(float(d[j]), 9), rows[j][0]) for j in order]))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    got = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.monotonically_increasing_id()), F.col("vec_id") % 100 == 0, **options).orderBy("query_id", "rank", "score").collect():
        got.setdefault(r.query_id, []).append((r.rank, round(r.score, 9), r.vec_id))
    return got


def test_rows_without_an_id_are_candidates(spark):
    assert found(spark, [(0, [1.0, 0.0]), (None, [1.0, 0.1]), (3, [1.0, 2.0])]) == {0: [(1, 0.1, None), (2, 2.0, 3)]}
    tied = [(0, [1.0, 0.0]), (None, [1.0, 1.0]), (5, [1.0, -1.0]), (None, [1.0, 1.0]), (4, [2.0, 0.0])]
    assert found(spark, tied) == {0: [(1, 1.0, 4), (2, 1.0, 5), (3, 1.0, None), (4, 1.0, None)]}


def test_a_third_of_all_rows_hold_one_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(600)] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, -0.0]) for i in range(600, 900)]
    got = found(spark, rows, rerank=700)
    assert [(q, [(s, i) for _, s, i in got[q]]) for q in sorted(got)] == [(q, r) for q, r in sorted(brute(rows))]
    assert [r for r, _, _ in got[600]] == list(range(1, 11)) and [i for _, _, i in got[600]] == list(range(601, 611)) and [i for _, _, i in got[700]] == list(range(600, 610))
    assert len(ann.classes_of(spark.createDataFrame([(i, v, i, 1 if i >= 600 else 2 + i, 0) for i, v in rows], "vec_id long, v array<double>, row long, k1 long, k2 long"), 10).collect()) == 601


@pytest.mark.parametrize("part_rows, chunk", [(20, 4096), (10, 3), (10**9, 2)])
def test_divided_lists_and_dealt_queries(spark, part_rows, chunk):
    """Most vectors lie in a few lists, so these are divided; recall stays, and scores are exact."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16)) * 0.6
    rows = [(i, (centres[i % 30 if i % 3 else 0] + rng.normal(size=16)).tolist()) for i in range(3000)]
    got, want = found(spark, rows, part_rows=part_rows, chunk=chunk), dict(brute(rows))
    hits = sum(len({i for _, _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values()) and hits >= 0.9 * 10 * len(want)
    at = dict(rows)
    for q, near in got.items():
        assert all(s == pytest.approx(float(np.linalg.norm(np.array(at[q]) - np.array(at[i]))), abs=1e-8) for _, s, i in near)
        assert [(s, i) for _, s, i in near] == sorted((s, i) for _, s, i in near)


@pytest.mark.parametrize("shape", ["no clusters", "far from the origin", "norms of all sizes"])
def test_recall_on_other_rows(spark, shape):
    """Neighbours lie in many cells: the width that the sample needs is measured."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8000, 24))
    x = {"no clusters": x, "far from the origin": 1e6 + x, "norms of all sizes": x * np.exp(2 * rng.normal(size=(8000, 1)))}[shape]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = found(spark, rows), dict(brute(rows))
    hits = sum(len({i for _, _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert len(want) == 80 and hits >= 0.93 * 10 * len(want)
