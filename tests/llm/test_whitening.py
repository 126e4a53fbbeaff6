"""Whitening against a plain eigendecomposition, exact integers and degenerate tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from utterlake.llm import whitening
from utterlake.llm.whitening import dqds, op12_whitening, principal, triangle, whiten

SCHEMA = "vec_id long, embedding array<double>"


def check(rows, vectors, components=8):
    """Every column against numpy and Python's integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors.values()]
    n, dims = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    away = {i: [n * a - s for a, s in zip(v, sums, strict=True)] for i, v in zip(vectors, x, strict=True)}
    d = np.array([[a / n for a in v] for v in away.values()])
    e, w = np.linalg.eigh(d.T @ d / n)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    k = min(components, dims)
    assert len(rows) == n * k and {(r.vec_id, r.component) for r in rows} == {(i, c) for i in vectors for c in range(1, k + 1)}
    signs = {}
    for r in rows:
        c = r.component - 1
        assert r.n == n and r.deviation == sum(a * a for a in away[r.vec_id])
        assert r.explained == pytest.approx(e[c] / (d * d).sum() * n, rel=1e-10) and r.identity_error < 1e-9
        want = float(np.array([a / n for a in away[r.vec_id]]) @ w[:, c] / math.sqrt(e[c]))
        if abs(want) > 1e-3:
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-9)
            assert signs.setdefault(c, r.whitened * want > 0) == (r.whitened * want > 0)
    back = np.array([[next(r.whitened for r in rows if r.vec_id == i and r.component == c + 1) for c in range(k)] for i in list(vectors)[:1]])
    assert back.shape == (1, k)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in table.collect()}
    out = op12_whitening(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(out.collect(), vectors)


def test_many_blocks_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    vectors = {i: (rng.normal(size=5) * [9, 3, 1, 0.2, 0.05] + 40).tolist() for i in range(200)}
    table = spark.createDataFrame(list(vectors.items()), SCHEMA).repartition(29)
    check(whiten(table).collect(), vectors)


def test_odd_rows(spark):
    rng = random.Random(1)
    good = {i: [rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(3, 1)] for i in range(40)} | {90: [0.0, 0.0, 0.0]}
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0]), (54, []), (55, [1.0, 2.0])]
    check(whiten(spark.createDataFrame([*good.items(), *bad], SCHEMA)).collect(), good)
    copies = spark.createDataFrame([(None, good[0]), (1, good[1]), (1, good[1]), (2, good[2]), (3, good[3])], SCHEMA)
    got = whiten(copies).collect()
    assert {r.n for r in got} == {5} and sorted(r.vec_id or 0 for r in got if r.component == 1) == [0, 1, 1, 2, 3]
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0 and whiten(spark.createDataFrame(bad[:5], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 3, SCHEMA)).count() == 0  # nothing varies
    flat = whiten(spark.createDataFrame([(i, [5.0, float(i), -2.0]) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1.0)
    clash = spark.createDataFrame([(i, v, "x", 1) for i, v in good.items()], SCHEMA + ", n string, v int")
    assert whiten(clash, components=2).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_beyond_64_bits(spark):
    vectors = {i: [float(i % 7) * 2.0**40, 3.0 * i, 1.0 - i] for i in range(30)}
    rows = whiten(spark.createDataFrame(list(vectors.items()), SCHEMA), components=1).collect()
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in vectors.items()}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    assert {r.vec_id: int(r.deviation) for r in rows} == {i: sum((30 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    huge = whiten(spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(4)], SCHEMA)).collect()
    assert all(r.deviation is None or r.deviation > 0 for r in huge) and {r.component for r in huge} <= {1, 2}


def test_solver_on_hard_matrices():
    rng = np.random.default_rng(5)
    q, p = (np.linalg.qr(rng.normal(size=(40, 40)))[0] for _ in range(2))
    cases = [
        rng.normal(size=(500, 64)) * 10.0 ** -np.arange(64),  # graded
        np.vstack([np.eye(16)] * 3),  # all equal
        np.repeat(rng.normal(size=(300, 8)), 4, axis=1),  # repeated columns
        rng.normal(size=(300, 3)) @ rng.normal(size=(3, 20)),  # rank 3
        (q * np.r_[1 + 1e-12 * np.arange(10), np.linspace(0.1, 0.5, 30)]) @ p,  # a cluster
        np.diag([3.0, 3, 3, 2, 2, 1, 1, 1, 1, 0, 0]),
    ]
    cases += [rng.integers(-2, 3, size=(rng.integers(1, 15), rng.integers(1, 12))).astype(float) for _ in range(150)]
    for x in cases:
        d = x.shape[1]
        squares, v = principal(triangle(np.vstack([np.zeros((d, d)), x])), 8)
        want = np.linalg.svd(x, compute_uv=False)[:8] ** 2
        k = int((want > 1e-20 * want.max(initial=0)).sum())
        assert len(squares) == k
        if k:
            assert np.allclose(squares, want[:k], rtol=1e-10) and np.abs(v.T @ v - np.eye(k)).max() < 1e-12
            assert np.abs(x.T @ (x @ v) - v * squares).max() < 1e-12 * d * squares[0]


def test_dqds_keeps_small_values():
    """Singular values over 30 powers of ten, each to high relative accuracy: a product of (1 + tiny) factors."""
    d = [10.0**-i for i in range(0, 31, 3)]
    got = dqds([x * x for x in d], [1e-80] * (len(d) - 1))
    assert np.allclose(got, [x * x for x in d], rtol=1e-12, atol=0)
