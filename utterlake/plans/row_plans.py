"""Queries of row predicates and mappings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rows as R
from .common import CLIPS, SCORES, Book, clips, scores, table

BOOK = Book()
add = BOOK.add
S, C = f"WITH {SCORES}", f"WITH {CLIPS}"


@add("pf1_label_mapping", "SELECT event_id, CASE event_type WHEN 'click' THEN 'LIGHTS_ON' WHEN 'signup' THEN 'MUSIC' ELSE event_type END AS intent FROM events")
def pf1(spark, d):
    return table(spark, d, "events").select("event_id", R.map_label(F.col("event_type"), {"click": "LIGHTS_ON", "signup": "MUSIC"}).alias("intent"))


@add(
    "pf2_row_selection",
    """WITH x AS (SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'no_join' WHEN o_orderstatus = 'P' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'unknown_text' WHEN o_orderpriority = '5-LOW' THEN 'out_of_grammar' WHEN o_totalprice > 300000 THEN 'accepted_other_intent' END AS reason
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON c_custkey = o_custkey)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1""",
)
def pf2(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    silence = F.col("o_orderstatus") == "P"
    why = R.drop_reason(
        [("no_join", F.col("c_custkey").isNull()), ("unknown_text", ~silence & (F.col("c_mktsegment") == "MACHINERY")), ("out_of_grammar", ~silence & (F.col("o_orderpriority") == "5-LOW")), ("accepted_other_intent", ~silence & (F.col("o_totalprice") > 300000))]
    )
    return o.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))




@add(
    "pf3_row_conversion",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'oos' ELSE 'v' END AS v, CASE WHEN l_linenumber = 2 AND l_suppkey % 2 = 0 THEN concat(l_partkey, '') ELSE concat('set ', l_partkey % 24, ':00 to ', l_returnflag) END AS t FROM lineitem),
p AS (SELECT *, trim(regexp_replace(CASE WHEN v = 'oos' THEN regexp_replace(t, '[0-9]', '', 'g') ELSE regexp_replace(t, ':00', '', 'g') END, ' +', ' ', 'g')) AS plain FROM x)
SELECT CASE WHEN v IS NULL THEN 'dropped' WHEN plain = '' THEN 'silence' WHEN v = 'oos' THEN 'oos' ELSE 'command' END AS kind, CASE WHEN v IS NOT NULL AND plain <> '' THEN plain END AS said, count(*) AS n FROM p GROUP BY 1, 2""",
)
def pf3(spark, d):
    x = table(spark, d, "lineitem").selectExpr("CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'oos' ELSE 'v' END AS v", "CASE WHEN l_linenumber = 2 AND l_suppkey % 2 = 0 THEN concat(l_partkey, '') ELSE concat('set ', l_partkey % 24, ':00 to ', l_returnflag) END AS t")
    kind, said = R.convert_row(F.col("t"), F.col("v"))
    return x.select(kind.alias("kind"), said.alias("said")).groupBy("kind", "said").agg(F.count(F.lit(1)).alias("n"))


@add("pf4_kind_dispatch", "SELECT s_suppkey, n_name AS bucket, r_name AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def pf4(spark, d):
    dim = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("bucket"), F.col("r_name").alias("label"))
    return R.dispatch(table(spark, d, "supplier"), dim, "s_nationkey").select("s_suppkey", "bucket", "label")


@add("pf5_already_noised", C + " SELECT source_dataset, count(*) FILTER (regexp_matches(source_dataset, '_(noisy|ambient)$') OR regexp_replace(filename, '\\.[^.]*$', '') LIKE '%\\_noisy' ESCAPE '\\') AS noised, count(*) AS n FROM clips GROUP BY 1")
def pf5(spark, d):
    return clips(spark, d).groupBy("source_dataset").agg(F.count_if(R.already_noised(F.col("source_dataset"), F.col("filename"))).alias("noised"), F.count(F.lit(1)).alias("n"))


@add("pf6_eligibility", C + " SELECT doc_id, bucket <> 'silence' AND length(trim(coalesce(transcript, ''))) > 0 AS by_bucket, label IN ('INTENT_1', 'INTENT_2', 'unknown') AS by_label FROM clips")
def pf6(spark, d):
    e = lambda labels: R.eligible(F.col("bucket"), F.col("transcript"), F.col("label"), labels)
    return clips(spark, d).select("doc_id", e(None).alias("by_bucket"), e(["INTENT_1", "INTENT_2", "unknown"]).alias("by_label"))


@add("pf7_group_class", "SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 'A' WHEN user_id % 4 = 0 THEN NULL WHEN concat('s', user_id) IN ('s1', 's2', 's3') OR user_id % 7 = 0 AND FALSE THEN 'A' WHEN user_id % 5 <> 0 THEN 'B' END AS cls, count(*) AS n FROM events GROUP BY 1, 2")
def pf7(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "CASE WHEN user_id % 9 = 0 THEN 'persona' WHEN user_id % 4 = 0 THEN 'other' ELSE 'main' END AS src", "CASE WHEN user_id IN (1, 2, 3) OR user_id % 5 <> 0 THEN concat('s', user_id) ELSE 'x' END AS grp")
    return e.groupBy("user_id", R.group_class(F.col("src"), F.col("grp"), ["s1", "s2", "s3"]).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@add("pf8_prefix_source", "SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'mobile' WHEN url LIKE 'https://%' THEN 'web' ELSE NULL END AS source FROM pages")
def pf8(spark, d):
    return table(spark, d, "pages").select("page_id", R.source_of(F.col("url"), {"https://m.": "mobile", "https://": "web"}).alias("source"))


@add("pf9_token_scrub", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)\\b(?:clown|idiot|moron)(?:''s|s)?\\b')")
def pf9(spark, d):
    return table(spark, d, "documents").where(~R.mentions(F.col("text"), ["clown", "idiot", "moron"])).select("doc_id")


@add("pf10_wake_word", "SELECT doc_id, regexp_matches(replace(lower(text), '''', ''), '\\b(?:license|licenses)\\b') AS wake FROM documents")
def pf10(spark, d):
    return table(spark, d, "documents").select("doc_id", R.mentions(F.replace(F.lower("text"), F.lit("'"), F.lit("")), ["license", "licenses"], False).alias("wake"))


@add(
    "pf11_unsafe_text",
    """SELECT page_id, array_to_string(list_filter([CASE WHEN trim(t) = '' THEN 'empty_text' END, CASE WHEN contains(t, ' - ') THEN 'dash' END, CASE WHEN regexp_matches(t, '[/\\\\]') THEN 'slash' END, CASE WHEN NOT regexp_matches(c, '^[A-Za-z0-9_.-]+$') THEN 'charset' END, CASE WHEN c IN ('.', '..') THEN 'dots' END], lambda x: x IS NOT NULL), ',') AS broken
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE url END AS t, CASE WHEN page_id % 7 = 0 THEN '..' ELSE split_part(url, '/', 4) END AS c FROM pages)""",
)
def pf11(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "CASE WHEN page_id % 5 = 0 THEN ' ' ELSE url END AS t", "CASE WHEN page_id % 7 = 0 THEN '..' ELSE split_part(url, '/', 4) END AS c")
    return p.select("page_id", F.array_join(R.violations(F.col("t"), F.col("c")), ",").alias("broken"))


_PATHS = "CASE l_linenumber WHEN 1 THEN concat('a/../b/', l_partkey) WHEN 2 THEN concat('./c/', l_partkey) WHEN 3 THEN concat('../x/', l_partkey) WHEN 4 THEN concat('/abs/', l_partkey) ELSE concat('a/b/../../../', l_partkey) END"
_BASE = "CASE l_linenumber WHEN 1 THEN concat('../../old/b/', l_partkey) WHEN 2 THEN concat('../../old/c/', l_partkey) WHEN 3 THEN concat('../../x/', l_partkey) WHEN 4 THEN concat('/abs/', l_partkey) ELSE concat('../../', l_partkey) END"


@add("pf12_path_rebase", f"SELECT DISTINCT {_PATHS} AS path, {_BASE} AS rebased FROM lineitem")
def pf12(spark, d):
    return table(spark, d, "lineitem").selectExpr(f"{_PATHS} AS path").distinct().select("path", R.rebase(F.col("path"), "old", 2).alias("rebased"))


@add("pf13_path_containment", f"SELECT DISTINCT {_PATHS} AS path, l_linenumber IN (1, 2) AS inside FROM lineitem")
def pf13(spark, d):
    return table(spark, d, "lineitem").selectExpr(f"{_PATHS} AS path").distinct().select("path", R.contained(F.col("path")).alias("inside"))


@add("pf14_acceptance", S + " SELECT bucket, count(*) FILTER (intent IS NOT NULL AND confidence >= 0.9) AS accepted, count(*) AS n FROM scores GROUP BY 1")
def pf14(spark, d):
    return scores(spark, d).groupBy("bucket").agg(F.count_if(R.accepted(F.col("intent"), F.col("confidence"), 0.9)).alias("accepted"), F.count(F.lit(1)).alias("n"))


@add("pf15_margin_gate", S + " SELECT i, coalesce(intent IS NOT NULL AND confidence >= 0.9, FALSE) AND (gap IS NULL OR gap >= 1.5) AS ok, CASE WHEN intent IS NOT NULL AND confidence >= 0.9 AND (gap IS NULL OR gap >= 1.5) THEN intent END AS answer FROM scores")
def pf15(spark, d):
    return R.gated(scores(spark, d), 0.9, 1.5).select("i", "ok", "answer")


@add("pf16_decision_order", S + " SELECT i, CASE WHEN intent IS NULL THEN CASE WHEN gap IS NOT NULL THEN 'incomplete_prefix' ELSE 'no_command' END WHEN gap < 1.5 THEN 'incomplete_prefix' WHEN confidence < 0.9 THEN 'threshold' END AS reason FROM scores")
def pf16(spark, d):
    return scores(spark, d).select("i", R.decision(0.9, 1.5).alias("reason"))


@add("pf17_per_intent", S + ", tau AS (SELECT label AS intent, round(avg(confidence), 4) AS tau FROM scores WHERE split = 'val' AND label <> 'click' AND label = intent GROUP BY 1) SELECT i, coalesce(confidence >= coalesce(tau, 0.93), FALSE) AS ok FROM scores LEFT JOIN tau USING (intent)")
def pf17(spark, d):
    s = scores(spark, d)
    tau = s.where("split = 'val' AND label <> 'click' AND label = intent").groupBy(F.col("label").alias("intent")).agg(F.round(F.avg("confidence"), 4).alias("tau"))
    return R.per_intent_accept(s, tau, 0.93).select("i", "ok")


@add("pf18_correctness", S + " SELECT i, coalesce(label = intent AND (slot_truth IS NULL OR lower(slot_truth) = lower(slot_pred)), FALSE) AS right_ FROM scores")
def pf18(spark, d):
    s = scores(spark, d)
    return s.select("i", R.correct(F.col("label"), F.col("intent"), F.col("slot_truth"), F.create_map(F.lit("state"), F.col("slot_pred"))).alias("right_"))


@add("pf19_class_acceptance", "WITH x AS (SELECT vec_id, list_position(e, list_max(e)) - 1 AS b, list_max(e) AS m FROM (SELECT vec_id, embedding[1:10] AS e FROM embeddings)) SELECT vec_id, b NOT IN (8, 9) AS plain, b NOT IN (8, 9) AND m::DOUBLE >= 0.2 AS ok FROM x")
def pf19(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 10).alias("e")).select("vec_id", (F.array_position("e", F.array_max("e")) - 1).alias("b"), F.array_max("e").cast("double").alias("m"))
    return x.select("vec_id", R.class_accept(F.col("b"), F.col("m"), None, [8, 9]).alias("plain"), R.class_accept(F.col("b"), F.col("m"), 0.2, [8, 9]).alias("ok"))


_B = "CASE WHEN k % 4 = 0 THEN 'click' ELSE intent END"


@add(
    "pf20_two_models",
    S + f", x AS (SELECT i, intent AS a, coalesce(confidence >= 0.93, FALSE) AS ao, {_B} AS b, k % 3 > 0 AND ({_B}) IS NOT NULL AS bo FROM scores) SELECT i, CASE WHEN ao THEN a WHEN bo THEN b END AS fallback, CASE WHEN ao THEN 'A' WHEN bo THEN 'B' END AS who, CASE WHEN bo AND a = b THEN a END AS agree FROM x",
)
def pf20(spark, d):
    x = scores(spark, d).selectExpr("i", "intent AS a", "coalesce(confidence >= 0.93, FALSE) AS ao", f"{_B} AS b", f"k % 3 > 0 AND ({_B}) IS NOT NULL AS bo")
    cols = [F.col(c) for c in ("a", "ao", "b", "bo")]
    answer, who = R.combine("fallback", *cols)
    return x.select("i", answer.alias("fallback"), who.alias("who"), R.combine("agree", *cols)[0].alias("agree"))


@add(
    "pf21_command_validation",
    "WITH v AS (SELECT o_orderpriority AS intent, o_orderpriority < '3' AS needs, list(DISTINCT o_orderstatus) AS vals FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' GROUP BY 1) SELECT o_orderkey, CASE WHEN needs IS NULL OR (needs AND slot IS NULL) THEN 'malformed' ELSE 'ok' END AS status, coalesce(NOT (needs IS NULL OR (needs AND slot IS NULL)) AND (NOT needs OR list_contains(vals, slot)), FALSE) AS changed FROM (SELECT o_orderkey, o_orderpriority AS intent, CASE WHEN o_orderkey % 6 > 0 THEN o_orderstatus END AS slot FROM orders) LEFT JOIN v USING (intent)",
)
def pf21(spark, d):
    o = table(spark, d, "orders")
    v = o.where("o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("intent")).agg(F.collect_set("o_orderstatus").alias("values")).withColumn("needs_slot", F.col("intent") < "3")
    c = o.selectExpr("o_orderkey", "o_orderpriority AS intent", "CASE WHEN o_orderkey % 6 > 0 THEN o_orderstatus END AS slot")
    return R.command_status(c, v).select("o_orderkey", "status", "changed")


@add("pf22_resume", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')")
def pf22(spark, d):
    done = table(spark, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "CASE WHEN l_returnflag = 'R' THEN 'ok' ELSE 'error' END AS status", "CASE WHEN l_linestatus = 'F' THEN 'x' END AS path")
    return R.resume(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@add(
    "pf23_noise_pools",
    C + ", x AS (SELECT doc_id, split, CASE WHEN bucket = 'silence' AND NOT starts_with(s, 'negative_') THEN 'noise' WHEN bucket = 'babble' AND (NOT starts_with(s, 'negative_') OR s = 'negative_babble') THEN 'babble' END AS pool FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'negative_babble' WHEN 1 THEN 'negative_x' ELSE source_dataset END AS s FROM clips)) SELECT doc_id, split, pool, row_number() OVER (PARTITION BY split, pool ORDER BY doc_id)::INT AS no FROM x WHERE pool IS NOT NULL",
)
def pf23(spark, d):
    x = clips(spark, d).withColumn("source_dataset", F.expr("CASE doc_id % 4 WHEN 0 THEN 'negative_babble' WHEN 1 THEN 'negative_x' ELSE source_dataset END"))
    x = x.select("doc_id", "split", R.noise_pools(x, "dataset").alias("pool")).where("pool IS NOT NULL")
    return x.withColumn("no", F.row_number().over(Window.partitionBy("split", "pool").orderBy("doc_id")))
