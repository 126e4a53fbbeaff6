"""Every stage of the pipeline: odd rows, empty tables, clashing names, and what each stage decides."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages():
    return dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    english = [r.text for r in real.where("lang = 'en' AND length(text) BETWEEN 1200 AND 6000").orderBy("doc_id").limit(6).collect()]
    assert len(english) == 6
    odd = [
        (90_001, None, "en", "x", 0), (90_002, "", None, None, 0), (90_003, "12 34 !!", "en", "x", 8), (None, english[0], "en", "x", None), (90_004, english[0] + " and more", "en", "x", 1),
        (90_005, english[1], "en", "x", 1), (90_005, english[1], "en", "x", 1), (90_006, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)), None, "x", 400),
        (90_007, "Mail jo@example.org or call +1 (743) 555-3824 today, all of you good people of the town.", "en", "x", 80),
        (90_008, english[2][:500] + " " + english[3][:500], "en", "x", 1000),
    ]
    return real.unionByName(spark.createDataFrame(odd, real.schema)).cache()


def test_stage_names(stages):
    assert list(stages) == ["language_id", "jaccard_join", "suffix_dedup", "pii", "packing"] and pipeline.ORACLE_SQL is None


def test_columns_and_empty_tables(spark, sf, docs, stages):
    for name, stage in stages.items():
        out = stage(spark, docs.where("false"), sf)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_columns_with_clashing_names(spark, sf, docs, stages):
    few = docs.where("doc_id >= 90000 OR doc_id IS NULL OR doc_id < 20").withColumns({"cls": F.lit(1), "anchor": F.lit("a"), "length": F.lit(2), "part": F.lit(3)})
    for name, stage in stages.items():
        out = stage(spark, few, sf)
        assert out.count() > 0 and (name == "packing" or out.columns == few.columns)


def test_language_drops_what_it_rejects(spark, sf, docs, stages):
    """Enough labelled rows to learn from, and the odd ones."""
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 90000").unionByName(docs.where("doc_id IS NULL OR doc_id >= 90000"))
    kept = {r.doc_id for r in stages["language_id"](spark, many, sf).select("doc_id").collect()}
    assert not kept & {90_001, 90_002, 90_003, 90_006} and {90_004, 90_005, 90_007, None} <= kept
    clean = {r.doc_id for r in many.where("doc_id < 90000 AND length(text) > 100 AND lang IS NOT NULL").select("doc_id").collect()}
    assert len(clean & kept) >= 0.99 * len(clean)


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_one_of_each_group_stays(spark, sf, docs, stages):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = sorted(((r.doc_id, r.text) for r in stages["jaccard_join"](spark, docs, sf).collect()), key=repr)
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    full = [i for i in range(len(rows)) if sets[i]]
    groups = {find(i) for i in full}
    assert len(kept) == len(groups) + len(rows) - len(full)
    first = {}
    for i in full:
        k = rows[i][0]
        first[find(i)] = min(first.get(find(i), (True, 0)), (k is None, k or 0))
    assert sorted(k for k, t in kept if shingles(t) and k is not None) == sorted(k for null, k in first.values() if not null)


def test_long_repeats_are_cut(spark, sf, docs, stages):
    import collections

    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.where("doc_id >= 90000 OR doc_id < 60").collect()]
    n = collections.Counter(hashlib.md5(b[i : i + 200]).digest() for _, b in rows for i in range(len(b) - 199))
    want = []
    for k, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if n[hashlib.md5(b[i : i + 200]).digest()] > 1:
                gone[i : i + 200] = b"\x01" * 200
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or left.strip():
            want.append((k, left))
    got = [(r.doc_id, r.text or "") for r in stages["suffix_dedup"](spark, docs.where("doc_id >= 90000 OR doc_id < 60"), sf).collect()]
    assert sorted(got) == sorted(want)


def test_personal_data_is_masked(spark, sf, docs, stages):
    got = {r.doc_id: r.text for r in stages["pii"](spark, docs.where("doc_id >= 90000"), sf).collect()}
    assert "jo@example.org" not in got[90_007] and "3824" not in got[90_007] and "good people" in got[90_007]
    assert got[90_001] is None and got[90_002] == ""


def test_packing_covers_every_row(spark, sf, docs, stages):
    out = stages["packing"](spark, docs, sf)
    assert out.where("piece = 0").count() == docs.count()


def test_run_equals_its_stages(spark, sf, monkeypatch):
    before, drops = spark.conf.get(pipeline.BATCH), []
    monkeypatch.setattr(pipeline, "drop", lambda df, drop=pipeline.drop: (drops.append(df._kept_at), drop(df)))
    out = pipeline.run(spark, sf)
    assert spark.conf.get(pipeline.BATCH) == before and len(set(drops)) == len(pipeline.STAGES) - 2
    out = out.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.keep(stage(spark, docs, sf), f"test-{name}", "snappy")
    again = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    strip = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(out) == strip(again) and len(out) > 50
