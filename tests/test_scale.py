"""Selection, permutations and carried openings against plain loops, on strata that hold most rows."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from utterlake import plans
from utterlake.functions.seeding import permuted
from utterlake.operators import collate, joins, metrics, ranks, splits


def test_permutation_takes_every_place_once(spark):
    rows = spark.range(1, 60).select(F.col("id").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("k"))
    for seed in (1, 2):
        got = rows.withColumn("p", permuted(F.col("k"), F.col("size"), seed, "x", F.lit("key"))).groupBy("size").agg(F.count_distinct("p").alias("d"), F.min("p").alias("a"), F.max("p").alias("z")).collect()
        assert all((r.d, r.a, r.z) == (r.size, 0, r.size - 1) for r in got)
    keys = spark.range(50).withColumn("p", permuted(F.lit(0), F.lit(1000).cast("long"), 1, "x", F.col("id"))).select("p").distinct().count()
    assert keys > 40  # keys have permutations of their own


def test_even_pairs_makes_only_the_plan(spark):
    clips = spark.createDataFrame([("a", i) for i in range(40)] + [("b", i) for i in range(3)] + [("c", 1)], "label string, clip int")
    personas = spark.createDataFrame([(i,) for i in range(7)], "persona int")
    out = splits.even_pairs(clips, personas, "label", "clip", "persona", 25, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = [tuple(r) for r in out.select("label", "clip", "persona").collect()]
    per = {x: [(c, p) for label, c, p in got if label == x] for x in "abc"}
    assert {x: len(p) for x, p in per.items()} == {"a": 25, "b": 21, "c": 7} and all(len(set(p)) == len(p) for p in per.values())
    assert len({c for c, _ in per["a"]}) == 25 and {p for _, p in per["c"]} == set(range(7))


@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_selection_equals_sorting(spark, few):
    rng = random.Random(few)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(900)] + [("hot", x) for x in (1e300, -1e300, float("inf"), 0.5, 0.5, 0.5)] + [("tied", 2.0)] * 50 + [("one", -3.5), (None, 4.0), (None, 1.0), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    strata = {g: sorted(v for x, v in rows if x == g and v is not None) for g in ("hot", "tied", "one", None)}
    want = [(g, r) for g, v in strata.items() for r in {0, len(v) // 2, len(v) - 1, max(0, len(v) - 2)}]
    got = {(r.g, r.rank): (r.v, r.before) for r in ranks.at_ranks(df, "g", "v", spark.createDataFrame(want, "g string, rank long"), few).collect()}
    assert got == {(g, r): (strata[g][r], sum(x < strata[g][r] for x in strata[g])) for g, r in want}
    near = {r.g: r.v for r in metrics.nearest_rank(df, "g", "v", 0.95).collect()}
    assert near == {g: v[round(0.95 * (len(v) - 1))] for g, v in strata.items()}


def test_loudest_level_sums_ties_exactly(spark):
    rows = [("a", float(1 + i // 4)) for i in range(103)] + [("b", 5.0)] * 9
    got = {r.g: r.db for r in metrics.loudest_level(spark.createDataFrame(rows, "g string, p double"), "g", "p", 0.1).collect()}
    top = sorted((p for g, p in rows if g == "a"), reverse=True)[:10]
    assert 10 ** (got["a"] / 10) == pytest.approx(sum(top) / 10) and 10 ** (got["b"] / 10) == pytest.approx(5.0)


def test_openings_are_carried_from_part_to_part(spark):
    """A session with most of the rows, long gaps without an opening, keys without any, null keys and times."""
    rng = random.Random(9)
    ranges = [("hot", s, s + rng.randint(1, 30_000), i) for i, s in enumerate(sorted(rng.sample(range(100_000), 40)))] + [("k", 5, 9, 99), (None, 0, 10, 77)]
    events = [("hot", t, i) for i, t in enumerate(rng.sample(range(120_000), 2000))] + [("k", 4, 9001), ("k", 5, 9002), ("k", 9, 9003), ("none", 5, 9004), (None, 5, 9005), ("k", None, 9006)]
    e, r = spark.createDataFrame(events, "s string, t long, i int").repartition(3), spark.createDataFrame(ranges, "s string, a long, z long, id int")
    out = joins.assign_interval(e, r, "s", "t", "a", "z", ["id"])
    want = {}
    for s, t, i in events:
        before = [x for x in ranges if x[0] == s and t is not None and x[1] <= t]
        if before and t < max(before, key=lambda x: x[1])[2]:
            last = max(before, key=lambda x: x[1])
            want[i] = (last[3], t - last[1])
    assert {x.i: (x.id, x.since) for x in out.collect()} == want and len(want) > 500
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.lstrip(" +-:").startswith("Window ")]
    assert len(windows) == 2 and any("_place" in x for x in windows)


def test_steps_take_exactly_their_share(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(1500)] + [(5000, None)], "i int, c string").repartition(4)
    out = splits.step_plan(df, "c", "i", {"all": 1.0, "none": 0.0, "half": 0.5, "some": 0.3}, 1, 2, {"some": F.col("i") % 2 == 0})
    got = {r.c: r for r in out.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s).alias(s) for s in ("all", "none", "half", "some")]).collect()}
    assert (got["big"].n, got["big"]["all"], got["big"]["none"], got["big"].half) == (1350, 1350, 0, 675) and got["big"].some in (225, 226)
    assert got["small"].some == 0 and got[None]["all"] == 1 and out.where("some AND i % 2 = 0").count() == 0


def test_prompts_of_a_speaker_with_most_clips(spark):
    rng = random.Random(11)
    rows = [("hot", "read" if rng.random() < 0.01 else "clip", i, rng.choice([300, 900, 3850, 3851, 7000, 11_000, 12_001])) for i in range(3000)] + [("long", "clip", i, 11_500) for i in range(20)] + [("few", "read", 1, 5000), (None, "clip", 4, 9000)]
    df = spark.createDataFrame(rows, "s string, kind string, k int, ms int").repartition(4)
    want = {}
    for speaker in {r[0] for r in rows}:
        length, taken = 0, []
        for _, k, ms in sorted((kind != "read", k, ms) for s, kind, k, ms in rows if s == speaker):
            longer = length + ms + (150 if taken else 0)
            if length < 8000 and longer <= 12_000:
                length, taken = longer, [*taken, k]
        if length >= 8000:
            want[speaker] = (length, ",".join(map(str, taken)))
    assert {r.s: (r.ms, r.clips) for r in splits.prompt_pack(df, "s", "kind", "k", "ms").collect()} == want and set(want) == {"hot", "long", None}


def test_silence_by_source(spark):
    """Rule D counts what its caller calls silence."""
    from utterlake.operators import decide

    rows = [("m", "clean", "own", "target_commands", i, True) for i in range(40)] + [("m", "clean", "hum", "babble", 90 + i, i == 0) for i in range(5)] + [("ref", "clean", "own", "target_commands", 200, True)]
    df = spark.createDataFrame(rows, "model string, tag string, source string, bucket string, i int, ok boolean")
    none = spark.createDataFrame([], "i int")
    rule = lambda **more: {r.model: r.D for r in decide.registered_rules(df, "model", "ref", none, "i", "tag", "source", "own", "persona", F.col("bucket") == "target_commands", F.lit(True), F.col("ok"), **more).collect()}["m"]
    assert rule() == "PASS" and rule(silence=F.col("source") == "hum") == "FAIL"


def test_greedy_split_keeps_a_family_together_behind_a_join(spark):
    """Sizes from many tasks, too large to be broadcast as planned; the totals turn out small, so Spark changes the join as it runs."""
    options = {"spark.sql.autoBroadcastJoinThreshold": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in options}
    rows = spark.range(0, 60_000, 1, 8).select(F.concat(F.lit("fam"), F.col("id") % 2).alias("fam"), (F.col("id") * 7919 % 20_011).alias("grp"))
    sizes = rows.groupBy("fam", "grp").agg(F.count(F.lit(1)).alias("n"))
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        got = {(r.fam, r.grp): r.split for r in splits.group_split(sizes, "fam", "grp", "n", 4, {"train": 8, "val": 1, "test": 1}).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    have, total = {}, {}
    count = {(r.fam, r.grp): r.n for r in sizes.collect()}
    for (fam, _), n in count.items():
        total[fam] = total.get(fam, 0) + n
    for fam, grp in sorted(count, key=lambda k: (k[0], hashlib.md5(f"4:group:{k[0]}:{k[1]}".encode()).hexdigest())):
        mine = have.setdefault(fam, {"test": 0, "train": 0, "val": 0})
        to = max(mine, key=lambda p: ((8 if p == "train" else 1) * total[fam] - 10 * mine[p], p))
        mine[to] += count[fam, grp]
        assert got[fam, grp] == to


def test_placement_keeps_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    rows = [(i, [-4e-7, 4e-7, -0.0, 0.0, -0.1234565, 0.1234565, -5e-7, 3.5, -1.0, 2.0, -3e-8, 1.0]) for i in range(12)] + [(12, [1.0]), (13, [float("nan"), float("-inf")]), (14, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.vec_id, *(str(list(x)) for x in (r.l, r.r, r.c))) for r in plans.queries()["ar6_placement"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted((v, *(str(x) for x in lists)) for v, *lists in con.execute(plans.oracles()["ar6_placement"]).fetchall())
    assert got == want and "-0.0" in got[0][1]


def test_set_counts_shuffle_and_group_once(spark):
    """Nulls are equal, copies count once; a task holds one map of keys, not one for each side and one for both."""
    a, b = [(1, None), (1, None), (2, 5), (3, 3), (None, None)], [(1, None), (4, 4), (4, 4), (3, 3), (6, 1), (7, 1)]
    out = collate.set_counts(*(spark.createDataFrame(x, "p long, s long") for x in (a, b)))
    assert tuple(out.first()) == (2, 3, 2) and out.columns == ["only_a", "only_b", "both"]
    assert out._jdf.queryExecution().sparkPlan().toString().count("HashAggregate(keys=[p") == 2  # partial and final
