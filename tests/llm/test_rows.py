"""Null, repeated and colliding ids: rows are told apart by id and text."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from utterlake.llm import jaccard_join, repeat_index


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def test_ids_null_and_minus_one_differ(spark):
    rows = [(-1, "a"), (None, "a"), (-1, None), (-1, ""), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(repeat_index.row_tag(F.col("doc_id"), F.col("text")))
    assert df.select("row", "tag").distinct().count() == len(rows)


def test_repeats_of_colliding_texts(spark):
    """Two texts of one 32-bit hash under one null id: what repeats in one is not cut from the other."""
    passage = words(random.Random(3), 60)
    ids = spark.range(200_000)
    one = ids.select(F.concat(F.lit(passage), F.lit(" "), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    two = ids.select(F.concat(*[F.sha2(F.concat(F.lit(c), F.col("id").cast("string")), 512) for c in "abcd"]).alias("t"))
    pair = one.select(F.col("t").alias("a"), F.hash("t").alias("h")).join(two.select(F.col("t").alias("b"), F.hash("t").alias("h")), "h").orderBy("a").first()
    assert pair is not None
    docs = spark.createDataFrame([(None, pair.a), (None, pair.b), (7, passage + " and its own end")], "doc_id long, text string")
    got = {r.text: (r.n_removed, r.kept_sha256) for r in repeat_index.remove_repeats(docs).collect()}
    assert got[pair.b] == (0, hashlib.sha256(pair.b.encode()).hexdigest())
    assert got[pair.a][0] == len(passage) + 1


def test_equal_rows_do_not_multiply_ranges(spark, monkeypatch):
    rng = random.Random(4)
    text = words(rng, 80)
    docs = spark.createDataFrame([(None, text)] * 30 + [(1, text[:300] + words(rng, 40))], "doc_id long, text string")
    seen = {}
    real = repeat_index.keep

    def watched(df, name, *a):
        seen[name] = real(df, name, *a)
        return seen[name]

    monkeypatch.setattr(repeat_index, "keep", watched)
    got = repeat_index.remove_repeats(docs).collect()
    assert len(got) == 31 and all(r.n_removed == len(text) for r in got if r.doc_id is None)
    # one row for the thirty equal ones, each of its ranges once
    cover = seen["cover"].select("row", "tag", F.size("ranges").alias("n"), F.size(F.array_distinct("ranges")).alias("d")).collect()
    assert len({(r.row, r.tag) for r in cover}) == len(cover) <= 2 and all(r.n == r.d for r in cover)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    a = [words(rng, 100) for _ in range(5)]
    return a, [x + " more" for x in a]


def test_keep_one_decides_by_row(spark, texts):
    a, near = texts
    rows = [
        (None, a[0]), (None, near[0]), (None, a[0]),  # a null id: one stays
        (5, a[1]), (9, near[1]), (9, a[2]),  # near[1] goes, the other text of id 9 stays
        (3, a[3]), (3, near[3]), (3, a[3]),  # one id: one stays
        (None, a[4]), (8, near[4]),  # nulls come last
        (None, ""), (None, None), (4, " "), (4, " "), (9, None),  # the empty set is linked with nothing
    ]
    got = kept(spark, rows)
    full = [r for r in got if r[1] and r[1].strip()]
    assert sum(k is None for k, _ in full) == 1 and sum(k == 3 for k, _ in full) == 1
    assert {r for r in full if r[0] not in (None, 3)} == {(5, a[1]), (9, a[2]), (8, near[4])} and len(full) == 5
    assert sorted((r for r in got if r not in full), key=repr) == sorted(rows[-5:], key=repr)
    assert got == kept(spark, rows[::-1])
