"""Queries of the evaluation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import accepted, wilson
from ..operators import metrics as M
from .common import CLIPS, SCORES, Book, clips, scores, table

BOOK = Book()
add = BOOK.add
S, C = f"WITH {SCORES}", f"WITH {CLIPS}"

def TARGET():
    return F.col("bucket") == "target_commands"


def OK():
    return accepted(F.col("intent"), F.col("confidence"), 0.9)

T_SQL, OK_SQL = "bucket = 'target_commands'", "coalesce(intent IS NOT NULL AND confidence >= 0.9, FALSE)"

def RIGHT():
    return F.coalesce(F.col("label") == F.col("intent"), F.lit(False))

R_SQL = "coalesce(label = intent, FALSE)"


@add("ag1_counts", C + " SELECT (CASE WHEN grouping(source_dataset) = 1 THEN 0 ELSE 1 END)::INT AS level, bucket, split, source_dataset, count(*) AS n FROM clips GROUP BY GROUPING SETS ((bucket, split), (split, source_dataset))")
def ag1(spark, d):
    return M.counts(clips(spark, d), [["bucket", "split"], ["split", "source_dataset"]])


@add("ag2_deficit", C + " SELECT split, greatest(count(*) FILTER (bucket <> 'babble') - count(*) FILTER (bucket = 'babble'), 0) AS deficit FROM clips GROUP BY 1")
def ag2(spark, d):
    return M.deficit(clips(spark, d), "split", F.col("bucket") == "babble")


@add("ag3_conditional_share", C + " SELECT split, count(*) AS n, count(*) FILTER (source_dataset LIKE '%ambient') / count(*)::DOUBLE AS share FROM clips GROUP BY 1")
def ag3(spark, d):
    return M.share(clips(spark, d), "split", F.col("source_dataset").endswith("ambient"))


@add("ag4_pass_rate", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') / count(*)::DOUBLE AS share FROM lineitem GROUP BY 1")
def ag4(spark, d):
    return M.share(table(spark, d, "lineitem"), "l_suppkey", F.col("l_returnflag") != "R")


@add(
    "ag5_throughput_projection",
    "WITH m AS (SELECT l_linestatus AS model, avg(l_quantity) AS mean_s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), x AS (SELECT l_linestatus AS model, greatest(count(*) FILTER (l_linenumber > 2) - count(*) FILTER (l_linenumber <= 2), 0) AS deficit FROM lineitem GROUP BY 1) SELECT model, round(mean_s, 6) AS mean_s, floor(deficit * 1.15 + 0.999)::BIGINT AS jobs, round(floor(deficit * 1.15 + 0.999) * mean_s / 3600 / 4, 6) AS hours FROM x JOIN m USING (model)",
)
def ag5(spark, d):
    x = table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "model")
    p = M.projection(x, "model", "l_quantity", F.col("l_returnflag") != "R", M.deficit(x, "model", F.col("l_linenumber") <= 2), 1.15, 4)
    return p.select("model", F.round("mean_s", 6).alias("mean_s"), "jobs", F.round("hours", 6).alias("hours"))


@add("ag6_confusion", S + f" SELECT label, coalesce(CASE WHEN {OK_SQL} THEN intent END, 'REJECTED') AS predicted, count(*) AS n FROM scores WHERE {T_SQL} GROUP BY 1, 2")
def ag6(spark, d):
    return M.confusion(scores(spark, d).where(TARGET()), "label", F.when(OK(), F.col("intent")))


@add("ag7_false_accepts", S + f" SELECT bucket, count(*) AS n, count(*) FILTER ({OK_SQL}) AS accepted, count(*) FILTER ({OK_SQL}) / count(*)::DOUBLE AS rate, count(*) FILTER ({OK_SQL} AND (gap IS NULL OR gap >= 1)) AS gated, count(*) FILTER ({OK_SQL} AND (gap IS NULL OR gap >= 1)) / count(*)::DOUBLE AS gated_rate FROM scores WHERE NOT ({T_SQL}) GROUP BY 1")
def ag7(spark, d):
    return M.false_accepts(scores(spark, d).where(~TARGET()), "bucket", OK(), F.col("gap").isNull() | (F.col("gap") >= 1))


GRID = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99]
_GRID = "grid AS (SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in GRID) + "]) AS threshold)"
SWEEP_SQL = _GRID + f", sw AS (SELECT threshold, count(*) FILTER ({T_SQL} AND intent IS NOT NULL AND confidence >= threshold) AS ta, count(*) FILTER (NOT ({T_SQL}) AND intent IS NOT NULL AND confidence >= threshold) AS fa, count(*) FILTER ({T_SQL}) AS nt, count(*) FILTER (NOT ({T_SQL})) AS nf FROM scores, grid WHERE split = 'val' GROUP BY 1), sweep AS (SELECT threshold, ta, fa, coalesce(ta / nullif(nt, 0)::DOUBLE, 0) AS target_rate, coalesce(fa / nullif(nf, 0)::DOUBLE, 0) AS false_rate, coalesce(ta / nullif(nt, 0)::DOUBLE, 0) - coalesce(fa / nullif(nf, 0)::DOUBLE, 0) AS j FROM sw)"


@add("ag8_threshold_sweep", S + f", {SWEEP_SQL} SELECT * FROM sweep")
def ag8(spark, d):
    return M.sweep(scores(spark, d).where("split = 'val'"), GRID, TARGET())


_MARGINS = [0.0, 0.5, 1.0, 2.0, 3.0, 5.0]
_MG = "mg AS (SELECT unnest([" + ", ".join(f"{m}::DOUBLE" for m in _MARGINS) + "]) AS margin)"
MARGIN_SQL = _MG + f", ms AS (SELECT margin, coalesce(count(*) FILTER ({T_SQL} AND {OK_SQL} AND (gap IS NULL OR gap >= margin)) / nullif(count(*) FILTER ({T_SQL}), 0)::DOUBLE, 0) AS target_rate, coalesce(count(*) FILTER (NOT ({T_SQL}) AND {OK_SQL} AND (gap IS NULL OR gap >= margin)) / nullif(count(*) FILTER (NOT ({T_SQL})), 0)::DOUBLE, 0) AS false_rate, coalesce(count(*) FILTER ({T_SQL} AND {OK_SQL} AND gap < margin) / nullif(count(*) FILTER ({T_SQL} AND {OK_SQL}), 0)::DOUBLE, 0) AS margin_rejects FROM scores, mg GROUP BY 1)"


@add("ag9_margin_sweep", S + f", {MARGIN_SQL} SELECT * FROM ms")
def ag9(spark, d):
    return M.margin_sweep(scores(spark, d), 0.9, _MARGINS, TARGET())


@add("ag10_exhaustive_sweep", S + f", p AS (SELECT confidence, count(*) FILTER ({T_SQL}) AS t, count(*) FILTER (NOT ({T_SQL})) AS f FROM scores WHERE confidence IS NOT NULL GROUP BY 1) SELECT confidence, (sum(t) OVER w)::BIGINT AS hits, (sum(f) OVER w)::BIGINT AS false_accepts FROM p WINDOW w AS (ORDER BY confidence DESC)")
def ag10(spark, d):
    return M.exhaustive(scores(spark, d), "confidence", TARGET())


def wilson_sql(k: str, n: str, upper: bool) -> str:
    s = "+" if upper else "-"
    return f"CASE WHEN {n} > 0 THEN least(greatest(({k} / {n}::DOUBLE + 3.8416 / (2 * {n}) {s} 1.96 * sqrt(({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n}), 0.0), 1.0) END"


@add(
    "ag11_group_breakdown",
    S + f", tr AS (SELECT DISTINCT grp AS g FROM scores WHERE grp % 2 = 0), a AS (SELECT source, count(*) AS n, count(*) FILTER ({OK_SQL}) AS accepted, count(*) FILTER ({OK_SQL} AND {R_SQL}) AS exact, count(DISTINCT grp) AS groups, count(DISTINCT g) AS in_train FROM scores LEFT JOIN tr ON g = grp WHERE {T_SQL} GROUP BY 1) SELECT source, n, accepted, exact, exact / n::DOUBLE AS rate, round({wilson_sql('exact', 'n', False)}, 6) AS low, round({wilson_sql('exact', 'n', True)}, 6) AS high, groups, in_train FROM a",
)
def ag11(spark, d):
    s = scores(spark, d)
    out = M.breakdown(s.where(TARGET()), "source", OK(), RIGHT(), "grp", s.where("grp % 2 = 0"))
    return out.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@add("ag12_wilson_interval", f"SELECT l_suppkey, round({wilson_sql('k', 'n', False)}, 6) AS low, round({wilson_sql('k', 'n', True)}, 6) AS high FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 1) AS k, count(*) FILTER (l_linenumber = 1) AS n FROM lineitem GROUP BY 1)")
def ag12(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("k"), F.count_if(F.col("l_linenumber") == 1).alias("n"))
    return x.select("l_suppkey", F.round(wilson(F.col("k"), F.col("n"), False), 6).alias("low"), F.round(wilson(F.col("k"), F.col("n"), True), 6).alias("high"))


@add("ag13_slot_accuracy", S + f" SELECT concat('slot', k % 3) AS slot, count(slot_truth) AS n, count(*) FILTER (lower(slot_truth) = lower(slot_pred)) AS right, count(*) FILTER (lower(slot_truth) = lower(slot_pred)) / nullif(count(slot_truth), 0)::DOUBLE AS rate, count(*) FILTER (slot_truth IS NULL) AS unparseable FROM scores WHERE {T_SQL} AND {R_SQL} GROUP BY 1")
def ag13(spark, d):
    return M.slot_accuracy(scores(spark, d).where(TARGET()).withColumn("slot", F.concat(F.lit("slot"), F.col("k") % 3)), RIGHT(), "slot_truth", "slot_pred", "slot")


_SR = "coalesce(slot_truth IS NULL OR lower(slot_truth) = lower(slot_pred), FALSE)"
_FULL = f"{OK_SQL} AND {R_SQL} AND {_SR}"
HEAD_SQL = f"""count(*) FILTER ({T_SQL}) AS targets, count(*) FILTER ({T_SQL} AND {OK_SQL} AND {R_SQL}) / nullif(count(*) FILTER ({T_SQL}), 0)::DOUBLE AS command_accuracy, count(*) FILTER ({T_SQL} AND {_FULL}) / nullif(count(*) FILTER ({T_SQL}), 0)::DOUBLE AS accuracy,
count(*) FILTER ({T_SQL} AND {_FULL}) / nullif(count(*) FILTER ({T_SQL} AND {OK_SQL} AND {R_SQL}), 0)::DOUBLE AS slot_accuracy, count(*) FILTER ({T_SQL} AND NOT {OK_SQL}) / nullif(count(*) FILTER ({T_SQL}), 0)::DOUBLE AS false_reject,
count(*) FILTER (bucket = 'babble' AND {OK_SQL}) / nullif(count(*) FILTER (bucket = 'babble'), 0)::DOUBLE AS oos_accept, count(*) FILTER (bucket = 'silence' AND {OK_SQL}) / nullif(count(*) FILTER (bucket = 'silence'), 0)::DOUBLE AS misfire,
count(*) FILTER ({T_SQL} AND grp % 4 = 0 AND {_FULL}) / nullif(count(*) FILTER ({T_SQL} AND grp % 4 = 0), 0)::DOUBLE AS human, count(*) FILTER ({T_SQL} AND grp % 4 <> 0 AND {_FULL}) / nullif(count(*) FILTER ({T_SQL} AND grp % 4 <> 0), 0)::DOUBLE AS synthetic"""

def SLOT_OK():
    return F.coalesce(F.col("slot_truth").isNull() | (F.lower("slot_truth") == F.lower("slot_pred")), F.lit(False))


@add("ag14_headline_block", S + f" SELECT {HEAD_SQL} FROM scores")
def ag14(spark, d):
    return M.headline(scores(spark, d), OK(), TARGET(), F.col("bucket") == "babble", RIGHT(), SLOT_OK(), F.col("grp") % 4 == 0)


@add("ag15_balanced_accuracy", S + f", p AS (SELECT CASE WHEN bucket = 'babble' THEN 'oos' ELSE (k % 20)::VARCHAR END AS cls, avg((CASE WHEN bucket = 'babble' THEN NOT {OK_SQL} ELSE {OK_SQL} AND {R_SQL} END)::INT) AS recall FROM scores WHERE bucket <> 'silence' GROUP BY 1) SELECT count(*) AS classes, round(avg(recall), 9) AS balanced_accuracy FROM p")
def ag15(spark, d):
    s = scores(spark, d).where("bucket <> 'silence'").withColumn("variation", F.col("k") % 20)
    return M.balanced(s, "variation", OK() & RIGHT(), F.col("bucket") == "babble", OK()).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@add("ag16_source_breakdown", S + f" SELECT source, count(*) AS n, count(*) FILTER ({OK_SQL} AND {R_SQL}) AS gated, count(*) FILTER ({R_SQL}) AS plain FROM scores WHERE {T_SQL} GROUP BY 1")
def ag16(spark, d):
    return M.by_source(scores(spark, d).where(TARGET()), "source", {"gated": OK() & RIGHT(), "plain": RIGHT()})


_B = "CASE WHEN k % 4 = 0 THEN 'click' ELSE intent END"


@add("ag17_agreement", S + f", x AS (SELECT *, {_B} AS b, coalesce(k % 3 > 0 AND ({_B}) IS NOT NULL, FALSE) AS bo FROM scores) SELECT count(*) FILTER ({OK_SQL} AND bo) AS both, count(*) FILTER ({OK_SQL} AND bo AND intent = b) AS same, count(*) FILTER ({OK_SQL}) AS a_rows, count(*) FILTER ({OK_SQL} AND intent = b) AS top1, count(*) FILTER ({OK_SQL} AND (intent = b OR k % 2 = 0)) AS top3 FROM x")
def ag17(spark, d):
    s = scores(spark, d).withColumn("b", F.expr(_B))
    b_ok = F.coalesce((F.col("k") % 3 > 0) & F.col("b").isNotNull(), F.lit(False))
    return M.agreement(s, F.col("intent"), F.col("b"), OK(), b_ok, (F.col("intent") == F.col("b")) | (F.col("k") % 2 == 0))


@add("ag18_confusable_pairs", S + f", p AS (SELECT label, min(other) AS other FROM (SELECT DISTINCT a.event_type AS label, b.event_type AS other FROM events a, (SELECT DISTINCT event_type FROM events) b WHERE b.event_type > a.event_type AND a.event_type IN ('click', 'purchase') AND b.event_type IN ('purchase', 'signup')) GROUP BY 1), x AS (SELECT label, CASE WHEN {OK_SQL} THEN intent END AS p FROM scores) SELECT label, other, count(*) FILTER (p = label) AS n_member, count(*) FILTER (p = other) AS n_other, count(*) FILTER (p <> label AND p <> other) AS n_else, count(*) FILTER (p IS NULL) AS n_reject FROM x JOIN p USING (label) GROUP BY 1, 2")
def ag18(spark, d):
    kinds = table(spark, d, "events").select("event_type").distinct()
    pairs = kinds.where("event_type IN ('click', 'purchase')").select(F.col("event_type").alias("label")).crossJoin(kinds.where("event_type IN ('purchase', 'signup')")).where("event_type > label").groupBy("label").agg(F.min("event_type").alias("other"))
    return M.confusable(scores(spark, d), pairs, "label", F.when(OK(), F.col("intent")))


@add("ag19_complementarity", S + f", x AS (SELECT {OK_SQL} AND {R_SQL} AS ar, coalesce(k % 3 > 0 AND ({_B}) = label, FALSE) AS br, CASE WHEN {OK_SQL} THEN 'A' WHEN k % 3 > 0 THEN 'B' END AS who FROM scores WHERE {T_SQL}) SELECT CASE WHEN ar AND br THEN 'both' WHEN ar THEN 'only_a' WHEN br THEN 'only_b' ELSE 'neither' END AS kind, coalesce(who, 'none') AS answered_by, count(*) AS n FROM x GROUP BY 1, 2")
def ag19(spark, d):
    s = scores(spark, d).where(TARGET())
    return M.complementarity(s, OK() & RIGHT(), F.expr(f"coalesce(k % 3 > 0 AND ({_B}) = label, FALSE)"), F.when(OK(), "A").when(F.col("k") % 3 > 0, "B"))


@add("ag20_precision_recall", S + ", c AS (SELECT DISTINCT unnest([label, intent]) AS cls FROM scores), x AS (SELECT cls, (SELECT count(*) FROM scores WHERE label = cls) AS support, (SELECT count(*) FROM scores WHERE label = cls AND intent = cls) AS tp, (SELECT count(*) FROM scores WHERE intent = cls) AS pred FROM c WHERE cls IS NOT NULL), r AS (SELECT cls, support, tp, coalesce(tp / nullif(pred, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall FROM x) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r")
def ag20(spark, d):
    return M.precision_recall(scores(spark, d), "label", "intent")


@add("ag21_subgroup_recall", S + f" SELECT source, count(*) AS n, avg(({OK_SQL} AND {R_SQL})::INT) AS recall FROM scores WHERE label = 'signup' GROUP BY 1")
def ag21(spark, d):
    return M.recall_by(scores(spark, d), "source", F.col("label") == "signup", OK() & RIGHT())


@add("ag22_prefix_far", S + f", x AS (SELECT concat('p', k % 8) AS prefix, CASE WHEN {OK_SQL} THEN intent END AS i FROM scores WHERE NOT ({T_SQL})), g AS (SELECT prefix, i, count(*) AS n FROM x GROUP BY 1, 2) SELECT prefix, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (i IS NOT NULL), 0)::BIGINT AS accepted, coalesce(string_agg(concat(i, ':', n), ',' ORDER BY i) FILTER (i IS NOT NULL), '') AS intents FROM g GROUP BY 1")
def ag22(spark, d):
    return M.prefix_far(scores(spark, d).where(~TARGET()).withColumn("prefix", F.concat(F.lit("p"), F.col("k") % 8)), "prefix", OK(), "intent")


@add("ag23_origin_far", S + f", x AS (SELECT coalesce(CASE WHEN k % 9 = 0 THEN NULL ELSE source END, '<missing>') AS key, {OK_SQL} AS ok FROM scores WHERE NOT ({T_SQL})) SELECT key, count(*) AS n, avg(ok::INT) AS rate, CASE key WHEN 'src2' THEN 1 WHEN 'src0' THEN 2 ELSE 3 END AS place FROM x GROUP BY 1")
def ag23(spark, d):
    s = scores(spark, d).where(~TARGET()).withColumn("o", F.when(F.col("k") % 9 != 0, F.col("source")))
    return M.ordered_rates(s, "o", OK(), ["src2", "src0"])


@add("ag24_phrase_false_reject", S + f" SELECT label, count(*) AS n, avg((NOT {OK_SQL})::INT) AS recall FROM scores WHERE {T_SQL} AND slot_truth = 'on' GROUP BY 1")
def ag24(spark, d):
    return M.recall_by(scores(spark, d), "label", TARGET() & (F.col("slot_truth") == "on"), ~OK())


@add("ag25_gate_rejects", S + f", x AS (SELECT concat('c', k % 6) AS competitor, label AS i FROM scores WHERE {T_SQL} AND {OK_SQL} AND gap < 1), g AS (SELECT competitor, i, count(*) AS n FROM x GROUP BY 1, 2) SELECT competitor, sum(n)::BIGINT AS n, sum(n)::BIGINT AS accepted, string_agg(concat(i, ':', n), ',' ORDER BY i) AS intents FROM g GROUP BY 1")
def ag25(spark, d):
    s = scores(spark, d).where(TARGET() & OK() & (F.col("gap") < 1)).withColumn("competitor", F.concat(F.lit("c"), F.col("k") % 6))
    return M.prefix_far(s, "competitor", F.lit(True), "label")


@add("ag26_histogram_buckets", S + f" SELECT CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < -1 THEN '<-1' WHEN gap < 0 THEN '[-1,0)' WHEN gap < 2.5 THEN '[0,2.5)' WHEN gap < 5 THEN '[2.5,5)' ELSE '>=5' END AS bucket_, count(*) AS n, avg({OK_SQL}::INT) AS rate FROM scores GROUP BY 1")
def ag26(spark, d):
    return scores(spark, d).groupBy(M.bucket_of(F.col("gap"), [-1, 0, 2.5, 5]).alias("bucket_")).agg(F.count(F.lit(1)).alias("n"), F.avg(OK().cast("int")).alias("rate"))


@add("ag27_snr_histogram", S + " SELECT source, (floor(gap / 5) * 5)::INT AS band, count(*) AS n, avg((value > 100)::INT) AS clipped FROM scores GROUP BY 1, 2")
def ag27(spark, d):
    return scores(spark, d).groupBy("source", (F.floor(F.col("gap") / 5) * 5).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 100).cast("int")).alias("clipped"))


@add("ag28_margin_grid", S + f", {_MG} SELECT margin, count(*) FILTER ({T_SQL} AND {OK_SQL} AND {R_SQL} AND (gap IS NULL OR gap >= margin)) AS right, count(*) FILTER (NOT ({T_SQL}) AND {OK_SQL} AND (gap IS NULL OR gap >= margin)) AS fa, count(*) FILTER (bucket = 'babble' AND {OK_SQL} AND (gap IS NULL OR gap >= margin)) AS fa_babble FROM scores, mg GROUP BY 1")
def ag28(spark, d):
    grid = spark.createDataFrame([(m,) for m in _MARGINS], "margin double")
    met = F.col("gap").isNull() | (F.col("gap") >= F.col("margin"))
    per = scores(spark, d).select(TARGET().alias("t"), RIGHT().alias("r"), OK().alias("ok"), (F.col("bucket") == "babble").alias("b"), "gap").groupBy("t", "r", "ok", "b", "gap").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(grid))
    total = lambda c: F.coalesce(F.sum(F.when(c & F.col("ok") & met, F.col("n"))), F.lit(0))
    return per.groupBy("margin").agg(total(F.col("t") & F.col("r")).alias("right"), total(~F.col("t")).alias("fa"), total(F.col("b")).alias("fa_babble"))


@add("ag29_metric_bundle", S + f" SELECT {HEAD_SQL} FROM scores WHERE gap IS NULL OR gap >= 1")
def ag29(spark, d):
    return M.headline(scores(spark, d).where("gap IS NULL OR gap >= 1"), OK(), TARGET(), F.col("bucket") == "babble", RIGHT(), SLOT_OK(), F.col("grp") % 4 == 0)


CONFIGS = [("loose", 0.8, 0.0), ("base", 0.9, 1.0), ("tight", 0.95, 2.0)]
CONFIG_SQL = "cfg AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {t}::DOUBLE, {m}::DOUBLE)" for c, t, m in CONFIGS) + ") v(config, th, mg))"
GRID_SQL = f"cells AS (SELECT config, split, cond, count(*) FILTER ({T_SQL}) AS n, count(*) FILTER ({T_SQL} AND {R_SQL} AND confidence >= th AND (gap IS NULL OR gap >= mg)) AS exact, count(*) FILTER (NOT ({T_SQL}) AND confidence >= th AND (gap IS NULL OR gap >= mg)) AS fa FROM scores, cfg GROUP BY 1, 2, 3)"


def cells(spark, d):
    """AG30: counts of every config by split and condition: one pass over the rows, a row a config at the end."""
    ok = {c: F.coalesce((F.col("confidence") >= th) & (F.col("gap").isNull() | (F.col("gap") >= mg)), F.lit(False)) for c, th, mg in CONFIGS}
    sums = [x for c, o in ok.items() for x in (F.count_if(TARGET() & RIGHT() & o).alias(f"exact_{c}"), F.count_if(~TARGET() & o).alias(f"fa_{c}"))]
    wide = scores(spark, d).groupBy("split", "cond").agg(F.count_if(TARGET()).alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(c).alias("config"), F.col("n"), F.col(f"exact_{c}").alias("exact"), F.col(f"fa_{c}").alias("fa")) for c in ok])
    return wide.select("split", "cond", F.inline(rows)).select("config", "split", "cond", "n", "exact", "fa")


@add("ag30_config_grid", S + f", {CONFIG_SQL}, {GRID_SQL} SELECT * FROM cells")
def ag30(spark, d):
    return cells(spark, d)


@add("ag31_block_merge", S + f" SELECT label, count(*) AS n, count(*) FILTER ({R_SQL}) AS right, count(*) FILTER ({R_SQL}) / count(*)::DOUBLE AS rate FROM scores WHERE {T_SQL} GROUP BY 1")
def ag31(spark, d):
    s = scores(spark, d).where(TARGET())
    block = lambda x: x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(RIGHT()).alias("right"))
    return M.merge_blocks([block(s.where(f"split = '{x}'")) for x in ("train", "val", "test")], ["label"], ["n", "right"], {"rate": ("right", "n")})


@add("ag32_latency_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95 FROM events GROUP BY 1")
def ag32(spark, d):
    return M.latency(table(spark, d, "events"), "event_type", "value")


@add("ag33_nearest_rank", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value FROM r WHERE i = round_even(0.95 * (n - 1), 0)")
def ag33(spark, d):
    return M.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


@add("ag34_median_duration", C + " SELECT bucket, count(*) AS n, round(quantile_cont(duration, 0.5), 3) AS p50 FROM clips GROUP BY 1")
def ag34(spark, d):
    return M.latency(clips(spark, d), "bucket", "duration").select("bucket", "n", "p50")


@add("ag35_group_concentration", C + ", g AS (SELECT label, group_id, count(*) AS n FROM clips WHERE group_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY label) AS t, row_number() OVER (PARTITION BY label ORDER BY n DESC, group_id DESC) AS r FROM g) SELECT label, t::BIGINT AS n, group_id AS top_group, n / t AS share, n * 100 >= t * 5 AS noted FROM r WHERE r = 1")
def ag35(spark, d):
    return M.concentration(clips(spark, d).where("group_id IS NOT NULL"), "label", "group_id")


@add("ag36_class_imbalance", C + ", a AS (SELECT label, count(*) AS before, count(*) FILTER (split = 'train' AND duration < 3) AS after FROM clips GROUP BY 1) SELECT *, max(before) OVER () / (min(before) OVER ())::DOUBLE AS ratio_before, max(after) OVER () / nullif(min(after) OVER (), 0)::DOUBLE AS ratio_after FROM a")
def ag36(spark, d):
    c = clips(spark, d)
    return M.imbalance(c, c.where("split = 'train' AND duration < 3"), "label")


@add("ag37_plan_audit", S + " SELECT label, count(*) AS n, count(gap) AS gap, count(confidence) AS confidence, count(slot_truth) AS slot_truth, count(*) FILTER (gap IS NULL AND confidence IS NULL AND slot_truth IS NULL) AS none FROM scores GROUP BY 1")
def ag37(spark, d):
    return M.plan_audit(scores(spark, d), "label", ["gap", "confidence", "slot_truth"])


@add("ag38_joint_exact", S + f" SELECT count(*) AS n, avg({R_SQL}::INT) AS intent, count(*) FILTER (lower(slot_truth) = lower(slot_pred)) / count(slot_truth)::DOUBLE AS slot, count(*) FILTER ({R_SQL} AND (slot_truth IS NULL OR lower(slot_truth) = lower(slot_pred))) / count(*)::DOUBLE AS joint FROM scores WHERE {T_SQL}")
def ag38(spark, d):
    return M.joint_exact(scores(spark, d).where(TARGET()), RIGHT(), "slot_truth", F.lower("slot_truth") == F.lower("slot_pred"))


@add("ag39_worst_classes", S + f" SELECT k, count(*) AS n, avg({R_SQL}::INT) AS accuracy FROM scores WHERE {T_SQL} GROUP BY 1 ORDER BY 3, 1 LIMIT 5")
def ag39(spark, d):
    return M.worst(scores(spark, d).where(TARGET()), "k", RIGHT(), 5)


@add("ag40_score_quantiles", S + " SELECT label, CASE WHEN k % 20 <= 6 THEN '<=6' WHEN k % 20 <= 10 THEN '7-10' WHEN k % 20 <= 15 THEN '11-15' ELSE '16+' END AS band, count(*) AS n, round(quantile_cont(confidence::DOUBLE, 0.05), 6) AS p05, round(quantile_cont(confidence::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(confidence::DOUBLE, 0.5), 6) AS p50, avg((confidence < 0.9)::INT) AS under FROM scores WHERE confidence IS NOT NULL GROUP BY 1, 2")
def ag40(spark, d):
    return M.score_quantiles(scores(spark, d), "label", F.col("k") % 20, "confidence", 0.9)


@add("ag41_overlap_audit", C + ", a AS (SELECT group_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits_a FROM clips WHERE bucket = 'babble' AND group_id IS NOT NULL GROUP BY 1), b AS (SELECT group_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits_b FROM clips WHERE bucket = 'silence' AND group_id IS NOT NULL GROUP BY 1) SELECT * FROM a JOIN b USING (group_id)")
def ag41(spark, d):
    c = clips(spark, d).where("group_id IS NOT NULL")
    return M.overlap_audit(c.where("bucket = 'babble'"), c.where("bucket = 'silence'"), "group_id", "split")


@add("ag42_loudest_level", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS r, greatest(floor(count(*) OVER (PARTITION BY user_id) * 0.1), 1) AS k FROM events) SELECT user_id, round(10 * log10(avg(value)), 6) AS db FROM r WHERE r <= k GROUP BY 1")
def ag42(spark, d):
    return M.loudest_level(table(spark, d, "events"), "user_id", "value").withColumn("db", F.round("db", 6))


@add("ag43_log_counts", "WITH x AS (SELECT page_id, unnest(string_split(html, '<')) AS line FROM pages) SELECT page_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '^li>')) AS items, count(*) FILTER (regexp_matches(line, '^a href=')) AS links, count(*) FILTER (regexp_matches(line, '^p>')) AS paragraphs FROM x GROUP BY 1")
def ag43(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.explode(F.split("html", "<")).alias("line"))
    return M.log_counts(lines, "page_id", "line", {"items": "^li>", "links": "^a href=", "paragraphs": "^p>"})
