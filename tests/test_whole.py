"""Queries over whole tables, without SQL, against plain loops on a small fixture or the smallest tables."""

from __future__ import annotations

import collections
import datetime
import hashlib
import itertools
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from utterlake import plans
from utterlake.functions import arrays
from utterlake.operators import splits


def load(sf, name, *columns):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def run(spark, sf, name):
    return plans.queries()[name](spark, sf)


def draw(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_greedy_group_split(spark, sf):
    sizes = collections.Counter((r["o_orderpriority"], r["o_custkey"]) for r in load(sf, "orders", "o_orderpriority", "o_custkey"))
    parts, want = {"train": 8, "val": 1, "test": 1}, set()
    for fam in {f for f, _ in sizes}:
        have, total = collections.Counter(), sum(n for (f, _), n in sizes.items() if f == fam)
        for g in sorted((g for f, g in sizes if f == fam), key=lambda g: draw(4, "group", fam, g)):
            to = max(parts, key=lambda p: (parts[p] * total - 10 * have[p], p))
            have[to] += sizes[fam, g]
            want.add((fam, g, to))
    assert {tuple(r) for r in run(spark, sf, "sp4_greedy_group_split_whole").collect()} == want


def test_prompt_packing(spark, sf):
    by, want = collections.defaultdict(list), set()
    for r in load(sf, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"):
        by[r["o_custkey"]].append((r["o_orderstatus"] != "F", r["o_orderkey"], round(r["o_totalprice"] / 200)))
    for spk, clips in by.items():
        length, out = 0, []
        for _, k, ms in sorted(clips):
            longer = length + ms + (150 if out else 0)
            if length < 8000 and longer <= 12000:
                length, out = longer, [*out, k]
        if length >= 8000:
            want.add((spk, length, ",".join(map(str, out))))
    assert {tuple(r) for r in run(spark, sf, "sp30_prompt_packing_whole").collect()} == want


def kth(k, size, clip):
    """Where the clip's permutation of 0 .. size - 1 takes k, step by step."""
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(k, b)
        for i in range(4):
            if i % 2 == 0:
                left = (left + int(draw(2, "pair", clip, i, right)[:8], 16)) % a
            else:
                right = (right + int(draw(2, "pair", clip, i, left)[:8], 16)) % b
        k = left * b + right
        if k < size:
            return k


def test_even_pairs(spark, sf):
    """Clips in seeded order take turns; a clip's k-th persona is where its own permutation takes k."""
    personas = sorted((r["s_suppkey"] for r in load(sf, "supplier", "s_suppkey")), key=lambda p: draw(2, "persona", p))
    by, want = collections.defaultdict(list), set()
    for r in load(sf, "part", "p_type", "p_partkey"):
        by[r["p_type"]].append(r["p_partkey"])
    for label, clips in by.items():
        clips.sort(key=lambda c, label=label: draw(2, "clip", label, c))
        turns = [(label, c, k) for k in range(len(personas)) for c in clips][:25]
        want |= {(label, c, personas[kth(k, len(personas), c)]) for label, c, k in turns}
    assert len(want) == sum(min(25, len(c) * len(personas)) for c in by.values())
    assert {tuple(r) for r in run(spark, sf, "sp22_even_pairs_whole").collect()} == want


def test_voice_split(spark, sf):
    n = collections.Counter(r["c_nationkey"] for r in load(sf, "customer", "c_nationkey"))
    total = sum(n.values())
    assert len(n) > 20
    val = [(abs(100 * sum(n[i] for i in v) - 8 * total), v) for v in itertools.combinations(sorted(n), 2)]
    best = min((abs(100 * sum(n[i] for i in t) - 30 * total) + e, t, v) for t in itertools.combinations(sorted(n), 3) for e, v in val if not set(t) & set(v))
    got = run(spark, sf, "sp10_voice_split_whole").collect()
    assert [tuple(r) for r in got] == [(best[0], ",".join(map(str, best[1])), ",".join(map(str, best[2])))]


def test_voice_split_of_far_ids(spark):
    ids = spark.createDataFrame([(1000 * i, 1) for i in range(30)], "no long, n long")
    assert tuple(splits.voice_split(ids, 2, 1).first()) == (700 + 140, "0,1000", "2000")


def test_sliding_windows(spark, sf):
    def micros(t):
        return (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)

    rows = [(r["user_id"], micros(r["ts"].replace(tzinfo=None)), r["value"]) for r in load(sf, "events", "user_id", "ts", "value")]
    hour, want = 3_600_000_000, collections.defaultdict(list)
    end = max(u for _, u, _ in rows)
    for user, u, value in rows:
        for i in range(4):
            start = (u // (6 * hour) - i) * 6 * hour
            if start + 24 * hour <= end:
                want[user, start].append(value)
    got = {(r.user_id, micros(r.start)): (micros(r.end), r.n, r.top) for r in run(spark, sf, "es1_sliding_windows_whole").collect()}
    assert got == {k: (k[1] + 24 * hour, len(v), max(v)) for k, v in want.items()}


def sign(k, n):
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n


def test_sign_test(spark, sf):
    k, n = collections.Counter(), collections.Counter()
    for r in load(sf, "events", "user_id", "value"):
        g = r["user_id"] % 10
        k[g] += r["value"] > 60
        n[g] += r["value"] > 60 or r["value"] < 12
    got = {r.g: (r.k, r.n, r.p) for r in run(spark, sf, "ar7_sign_test_whole").collect()}
    assert set(got) == set(n)
    for g, (a, b, p) in got.items():
        assert (a, b) == (k[g], n[g]) and p == pytest.approx(sign(a, b), abs=1e-6)


def test_sign_test_of_many_coins(spark):
    cases = [(0, 0), (0, 1), (3, 5), (500, 1000), (501, 1001), (0, 1500), (1500, 1500), (1001, 2000), (1000, 2000), (999, 2000), (2530, 5000), (2400, 5000), (5100, 10001)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", arrays.sign_test(F.col("k"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(sign(r.k, r.n), rel=1e-9), (r.k, r.n)
