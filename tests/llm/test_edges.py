"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; comparisons with plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm import ann, language_id, packing, quality, quality_rules, repeat_index, sharding

LONG = "the quick brown fox jumps over the lazy dog and runs away " * 8000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "12 !!"), (5, LONG), (6, "le chat est sur la table et le chien dort"), (6, "le chat est sur la table et le chien dort"), (None, "the cat is on the table and the dog sleeps")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def languages(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d, language_id.fit(d.where(~language_id.held_out(F.col("doc_id"))))


def test_language_of_odd_rows(languages, odd):
    got = language_id.predict(odd.withColumns({"n": F.lit(1), "lang": F.lit("xx"), "row": F.lit("x")}), languages[1]).collect()
    assert len(got) == len(TEXTS) and set(got[0].asDict()) >= {"n", "lang", "row"}
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3, 4))
    assert by[5].lang_pred == "en" and len({(r.lang_pred, r.score) for r in got if r.doc_id == 6}) == 1
    with pytest.raises(ValueError):
        language_id.predict(odd.withColumn("score", F.lit(1)), languages[1])


def test_language_equals_brute_force(languages):
    """Every held-out row against a loop over its own n-grams and all centroids."""
    docs, model = languages
    rows = language_id.predict(docs.where(language_id.held_out(F.col("doc_id"))), model).collect()
    assert len(rows) > 30
    for r in rows:
        slots = np.zeros(1 << language_id.BITS)
        for n in (1, 2, 3, 4):
            raw = folded(r.text)
            for i in range(len(raw) - n + 1):
                code = 0
                for b in raw[i : i + n]:
                    code = (code * 257 + b) & 0xFFFFFFFF
                slots[((code ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language_id.BITS)] += 1
        v = np.log1p(slots) * model.idf
        sims = model.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        assert abs(r.score - min(max(sims.max(), 0), 1)) < 1e-4
        if np.sort(sims)[-1] - max((s for s, l in zip(sims, model.langs, strict=True) if l != r.lang_pred), default=-1) > 1e-4:
            assert model.langs[int(np.argmax(sims))] == r.lang_pred


def folded(text):
    out, raw = [], text.encode()
    for i, b in enumerate(raw):
        if b < 128:
            out.append(ord(chr(b).lower()) if chr(b).isalpha() else 32)
        else:
            out.append(b + 32 if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97 else b)
    return out


def test_language_ties_take_the_first_name(spark):
    """Two languages of the same texts: equal cosines, the first in alphabetical order."""
    rows = [(i, f"some words about number {i % 7} and more", lang) for i in range(40) for lang in ("zz", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, least=1)
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"aa"}


def test_likelihood_of_the_ordinal_model():
    """The fitted model against a plain loop over the cumulative-link likelihood: no small step of any threshold or of any weight improves it."""
    rng = np.random.default_rng(5)
    rows, y = [], []
    for i in range(300):
        grade = i % 3
        slots = np.unique(rng.choice(40, 8)) + 40 * grade * (rng.random() < 0.6)
        rows.append((slots.astype(np.int64), np.ones(len(slots))))
        y.append(grade)
    y = np.array(y)
    model = quality.descend(rows, y, 3, 2000, 0.1, 0.0)

    def loss(w, theta):
        total = 0.0
        for (slots, values), grade in zip(rows, y.tolist(), strict=True):
            z = float((w[slots] * values).sum())
            above = lambda k: 1 / (1 + math.exp(-(theta[k] - z)))  # noqa: B023, E731
            p = (above(grade) if grade < 2 else 1.0) - (above(grade - 1) if grade else 0.0)
            total -= math.log(max(p, 1e-12)) / 100
        return total

    w, theta = model.weights.astype(float), np.array(model.thresholds, float)
    assert list(theta) == sorted(theta)
    best = loss(w, theta)
    assert best < loss(np.zeros_like(w), np.array([-math.log(2), math.log(2)])) - 0.1
    for k in (0, 1):
        for step in (-0.3, 0.3):
            moved = theta.copy()
            moved[k] += step
            if moved[0] <= moved[1]:
                assert loss(w, moved) > best - 1e-3
    for slot in (0, 45, 90):
        for step in (-0.5, 0.5):
            moved = w.copy()
            moved[slot] += step
            assert loss(moved, theta) > best - 1e-3


def test_quality_of_odd_rows(spark, odd):
    graded = spark.createDataFrame([(i, f"good clean words {i % 5}" if i % 2 else f"bad spam noise {i % 5}", 2 if i % 2 else 0) for i in range(120)], "key long, text string, grade int")
    model = quality.fit(graded)
    got = quality.score(odd.withColumn("grade", F.lit(9)), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.expected_grade <= 2 and 0 <= r.tail <= 1 for r in got)
    assert len({(r.expected_grade, r.tail) for r in got if r.doc_id == 6}) == 1
    assert len({(r.expected_grade, r.tail) for r in got if r.doc_id in (1, 2)}) == 1  # null and empty alike
    assert quality.score(odd.where("false"), model).count() == 0
    assert {r.selected for r in quality.score(odd, None).collect()} == {False}
    with pytest.raises(ValueError):
        quality.score(odd.withColumn("tail", F.lit(0.0)), model)
    ties = quality.score(spark.createDataFrame([("good clean words 1",), ("words good 1 clean",)], "text string"), model).collect()
    assert ties[0].expected_grade == pytest.approx(ties[1].expected_grade)


def test_packing_leaves_other_columns_out(odd):
    clash = odd.withColumns({"length": F.lit("x"), "piece": F.lit(1), "sequence_id": F.lit(2), "rank": F.lit(3)})
    strip = lambda d: sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(d).collect())
    got = strip(clash)
    assert got == strip(odd) and len([r for r in got if r[0] == 6]) == 2 and max(r[1] for r in got) >= 20


def test_placed_pieces_in_blocks(spark):
    """Ranks meet the placement that starts last before them, across blocks of ranks."""
    places = [(7, 0, 1000, 0, 1, 0), (7, 1000, 3, 50, 1, 7), (7, 1003, 5000, 90, 2, 0), (9, 0, 10, 900, 1, 0)]
    p = spark.createDataFrame(places, "length long, first long, n long, bin long, per int, off int")
    ranked = spark.createDataFrame([(7, r, r) for r in range(0, 6003, 7)] + [(9, 4, -1), (11, 0, -2)], "length long, rank long, doc_id long")
    got = {r.doc_id: r.first for r in packing.placed_pieces(ranked, p, block=64).collect()}
    assert got[-1] == 0 and got[-2] is None
    assert all(f == (0 if d < 1000 else 1000 if d < 1003 else 1003) for d, f in got.items() if d >= 0)


def test_shards_equal_a_run_with_one_more(odd, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd)
    now = sorted(((repr(r.doc_id), r.text_crc32, r.grown_shard) for r in sharding.external_shuffle(docs, 24).collect()), key=repr)
    more = sorted(((repr(r.doc_id), r.text_crc32, r.shard) for r in sharding.external_shuffle(docs, 25).collect()), key=repr)
    assert now == more


def test_shards_of_equal_rows(spark):
    rows = spark.createDataFrame([(5, "same " * 50)] * 400, "doc_id long, text string").repartition(8)
    got = sharding.external_shuffle(rows, bucket_bytes=500).select("shard", "slot", "bucket").collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(400))
    assert len({r.bucket for r in got}) > 1


def test_buckets_of_a_hot_shard(spark):
    """A third of all rows share one id and so a shard: its buckets keep to the bound as others do."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(" " * 72)).alias("text")).repartition(8)
    got = sharding.external_shuffle(rows, bucket_bytes=20_000)
    sizes = [r.b for r in got.groupBy("bucket").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) < 2 * 20_000 and sum(sizes) == 3000 * 208
    for r in got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.count_distinct("slot").alias("d")).collect():
        assert (r.a, r.z, r.d) == (0, r.n - 1, r.n)


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.5, 0.5]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "list": F.lit("x"), "v": F.lit(2)})
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(df, F.col("vec_id") == 0).collect())
    one = [(0, 1, 0, 0.0), (0, 2, 1, round(math.hypot(0.1, 0.1), 6)), (0, 3, 1, round(math.hypot(0.5, 0.5), 6))]
    assert got == sorted(one * 2)  # each query row has the three other rows


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_neighbour_recall(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        near = np.lexsort((ids, ((x - x[q]) ** 2).sum(1)))
        want = {int(ids[i]) for i in near if i != q} if len(ids) <= 11 else set([int(ids[i]) for i in near if i != q][:10])
        hits, total = hits + len(want & got.get(int(ids[q]), set())), total + len(want)
    assert hits >= 0.9 * total


def test_rules_of_very_long_texts(spark):
    text = ("word " * 30_000) + "\n" + ("same line\n" * 50)
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_dup_lines) == (30_100, 49) and r.base_failed and not r.kept


def test_hot_anchors_are_cut_again(spark):
    """A line in many surroundings, shorter and longer than the k-grams, and a passage that does repeat among them."""
    import collections
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    line, most = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(24))[:190]
    texts = [f"{' '.join(word() for _ in range(30))} {line if i % 2 else most} {' '.join(word() for _ in range(30))}" for i in range(60)]
    texts += [texts[3][100:420], texts[4][50:400]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = {}
    for d, t in enumerate(texts):
        gone = set()
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        want[d] = len(gone)
    for hot in (1, 5, 2000):
        assert {r.doc_id: r.n_removed for r in repeat_index.remove_repeats(docs, hot_anchor=hot).collect()} == want
    assert sum(v > 0 for v in want.values()) >= 4


def test_gram_hashes_of_any_length():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, 500).astype(np.uint8)
    for k in (1, 5, 64, 128, 200):
        h = repeat_index.gram_hashes(a, k)
        assert len(h) == 500 - k + 1
        names = {}
        for i in range(len(h)):
            assert names.setdefault(a[i : i + k].tobytes(), h[i]) == h[i]
        assert len(set(names.values())) == len(names)
