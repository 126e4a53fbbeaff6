"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .common import CLIPS, SCORES, Book, clips, scores, table
from .text_plans import PHRASES, PREFIXES, phrases

BOOK = Book()
add = BOOK.add
S, C = f"WITH {SCORES}", f"WITH {CLIPS}"


@add("jn1_lookup_join", "WITH side AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT c_custkey, p, p IS NULL AS missed FROM customer LEFT JOIN side ON o_custkey = c_custkey")
def jn1(spark, d):
    side = J.last_wins(table(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey AS c_custkey", "o_orderpriority AS p", "o_orderkey"), "c_custkey", "o_orderkey")
    return J.lookup(table(spark, d, "customer").select("c_custkey"), side.select("c_custkey", "p"), "c_custkey")


@add("jn2_mandatory_join", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def jn2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return J.mandatory(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey")


@add(
    "jn3_polymorphic_join",
    C + ", x AS (SELECT doc_id, doc_id % 50 AS base, regexp_replace(source_dataset, '_ambient$', '') AS s FROM clips) SELECT doc_id, CASE s WHEN 'set0' THEN p_name WHEN 'set1' THEN '' END AS found, s IN ('set0', 'set1') AS known FROM x LEFT JOIN part ON s = 'set0' AND p_partkey = base",
)
def jn3(spark, d):
    c = clips(spark, d).select("doc_id", "source_dataset", (F.col("doc_id") % 50).alias("base"))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("base"), F.col("p_name").alias("transcript"))
    return J.polymorphic(c, {"set0": t}, {"set1": ""}).select("doc_id", "found", "known")


_SPAN = "side AS (SELECT o_custkey AS g, min_by(o_orderkey % 7, o_orderkey)::DOUBLE AS s, min_by(o_orderkey % 23, o_orderkey)::DOUBLE AS e FROM orders GROUP BY 1), base AS (SELECT c_custkey AS g, (c_custkey % 19)::DOUBLE AS duration FROM customer), j AS (SELECT base.g, duration, CASE WHEN e IS NULL THEN 'missing' WHEN e <= duration + 0.15 THEN 'mapped' ELSE 'failed' END AS status, CASE WHEN e <= duration + 0.15 THEN s END AS start_s, CASE WHEN e <= duration + 0.15 THEN e END AS end_s FROM base LEFT JOIN side USING (g))"


def spans(spark, d):
    side = table(spark, d, "orders").selectExpr("o_custkey AS g", "o_orderkey", "cast(o_orderkey % 7 AS double) AS start_s", "cast(o_orderkey % 23 AS double) AS end_s")
    base = table(spark, d, "customer").selectExpr("c_custkey AS g", "cast(c_custkey % 19 AS double) AS duration")
    return J.first_match(base, side, ["g"], "o_orderkey", 0.15)


@add("jn4_first_match", f"WITH {_SPAN} SELECT g, status, start_s, end_s FROM j")
def jn4(spark, d):
    return spans(spark, d).select("g", "status", "start_s", "end_s")


@add("jn5_ancestor_chain", f"WITH {_SPAN}, c AS (SELECT s_suppkey AS k, s_suppkey * 3 AS parent FROM supplier), kid AS (SELECT k, start_s FROM c LEFT JOIN j ON g = parent) SELECT p_partkey, start_s FROM part LEFT JOIN kid ON k = p_partkey % 50")
def jn5(spark, d):
    top = spans(spark, d).select(F.col("g").alias("parent"), "start_s")
    kid = J.lookup(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 3).alias("parent")), top, "parent").select("k", "start_s")
    return J.lookup(table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("k")), kid, "k").select("p_partkey", "start_s")


_JOBS = "jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 17 = 0 THEN 'error' ELSE 'ok' END AS status FROM orders)"


def jobs(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS job_id", "CASE WHEN o_orderkey % 17 = 0 THEN 'error' ELSE 'ok' END AS status")


@add("jn6_qa_verdict", f"WITH {_JOBS} SELECT job_id, CASE WHEN status = 'error' THEN 'generation_error' WHEN job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) THEN 'missing_qa_report' WHEN job_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'qa_flagged' ELSE 'pass' END AS verdict FROM jobs")
def jn6(spark, d):
    x = table(spark, d, "lineitem")
    return J.qa_verdict(jobs(spark, d), x.where("l_linenumber = 2").select(F.col("l_orderkey").alias("job_id")), x.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))).select("job_id", "verdict")


@add(
    "jn7_gate_join",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) ELSE coalesce(p_size <= 40 AND NOT contains(p_name, 'red'), FALSE) END AS passed FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40",
)
def jn7(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS unit", "l_partkey AS name", "CASE WHEN l_linestatus = 'O' THEN 'mix' ELSE 'free' END AS kind")
    p = table(spark, d, "part")
    reports = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("unit"))
    return J.gate(x, reports, p.where("p_size > 40").select(F.col("p_partkey").alias("name")), p.where("p_size <= 40").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("decode")), F.contains("decode", F.lit("red"))).select("l_orderkey", "l_linenumber", "passed")


@add("jn8_seen_elsewhere", "WITH b AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 10 = 0), x AS (SELECT doc_id, source, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0) SELECT doc_id, CASE WHEN h IN (SELECT h FROM b) THEN 'identical' WHEN source IN ('src3', 'src8') THEN 'speaker' END AS reason FROM x")
def jn8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    return J.seen_elsewhere(docs.where("doc_id % 10 <> 0"), [("identical", "h", docs.where("doc_id % 10 = 0")), ("speaker", "source", docs.where("source IN ('src3', 'src8')"))]).select("doc_id", "reason")


_ST = "x AS (SELECT doc_id, md5(text) AS hash, concat('d', doc_id) AS stem, CASE WHEN doc_id % 4 = 0 THEN concat('d', doc_id // 4) END AS parent FROM documents), bad AS (SELECT stem FROM x WHERE hash IN (SELECT md5(text) FROM documents WHERE doc_id % 9 = 0))"


@add("jn9_decontaminate", f"WITH {_ST} SELECT doc_id FROM x WHERE stem NOT IN (SELECT stem FROM bad) AND (parent IS NULL OR parent NOT IN (SELECT stem FROM bad))")
def jn9(spark, d):
    x = table(spark, d, "documents").selectExpr("doc_id", "md5(text) AS hash", "concat('d', doc_id) AS stem", "CASE WHEN doc_id % 4 = 0 THEN concat('d', doc_id div 4) END AS parent")
    return J.decontaminate(x, x.where("doc_id % 9 = 0")).select("doc_id")


@add("jn10_rename_map", "WITH a AS (SELECT md5(text) AS hash, min(concat('a', doc_id)) AS old, count(*) AS n FROM documents WHERE doc_id % 3 > 0 GROUP BY 1), b AS (SELECT md5(text) AS hash, min(concat('b', doc_id)) AS new, count(*) AS m FROM documents WHERE doc_id % 3 < 2 GROUP BY 1) SELECT hash, CASE WHEN n = 1 AND m = 1 THEN old END AS old, CASE WHEN n = 1 AND m = 1 THEN new END AS new, n > 1 OR m > 1 AS dup FROM a JOIN b USING (hash)")
def jn10(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("name")
    return J.rename_map(x.where("doc_id % 3 > 0").select("hash", name("a")), x.where("doc_id % 3 < 2").select("hash", name("b")))


_ASK = "CASE WHEN p_size <= 20 THEN concat('make it ', lower(p_type), CASE WHEN length(p_type) > 5 THEN concat(' ', p_size) ELSE '' END) ELSE p_name END"


@add("jn11_dictionary_match", f"WITH {PHRASES} SELECT p_partkey, q.intent, q.value FROM (SELECT p_partkey, {_ASK} AS text FROM part) LEFT JOIN (SELECT DISTINCT text, intent, value FROM phrases) q USING (text)")
def jn11(spark, d):
    asked = table(spark, d, "part").selectExpr("p_partkey", f"{_ASK} AS text", "upper(p_type) AS label")
    return J.dictionary_match(asked, phrases(spark, d)).select("p_partkey", "intent", "value")


@add("jn12_prefix_join", f"WITH {PHRASES}, {PREFIXES} SELECT p_partkey, prefix FROM (SELECT p_partkey, {_ASK} AS text FROM part), prefixes WHERE starts_with(text, prefix || ' ')")
def jn12(spark, d):
    from ..functions.text import word_prefixes

    return J.prefix_join(table(spark, d, "part").selectExpr("p_partkey", f"{_ASK} AS text"), word_prefixes(phrases(spark, d)), 8).select("p_partkey", "prefix")


@add("jn13_product_plan", "WITH p AS (SELECT s_suppkey, n_nationkey, concat(s_suppkey % 50, '_', n_name) AS name FROM supplier, nation) SELECT s_suppkey, n_nationkey, name, count(*) OVER (PARTITION BY name) > 1 AS clash FROM p")
def jn13(spark, d):
    return J.plan_product(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "nation").select("n_nationkey", "n_name"), F.concat((F.col("s_suppkey") % 50).cast("string"), F.lit("_"), "n_name")).drop("n_name")


_RANGES = "r AS (SELECT user_id, event_id AS rid, epoch_us(ts) AS t0, epoch_us(ts) + 20000000000 AS t1 FROM events WHERE event_type = 'signup')"


@add("jn15_interval_assignment", f"WITH {_RANGES}, x AS (SELECT event_id, e.user_id, epoch_us(ts) AS t, rid, t0, t1, row_number() OVER (PARTITION BY event_id ORDER BY t0 DESC) AS n FROM events e JOIN r ON r.user_id = e.user_id AND t0 <= epoch_us(ts)) SELECT event_id, rid, t - t0 AS since FROM x WHERE n = 1 AND t < t1")
def jn15(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    r = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("rid"), F.col("t").alias("t0"), (F.col("t") + 20_000_000_000).alias("t1"))
    return J.assign_interval(e.drop("event_type"), r, "user_id", "t", "t0", "t1", ["rid"]).select("event_id", "rid", "since")


@add("jn16_run_alignment", S + ", b AS (SELECT i, CASE WHEN k % 11 = 0 THEN NULL ELSE intent END AS intent FROM scores) SELECT count(*) AS n, count(*) FILTER (a.intent IS DISTINCT FROM b.intent) AS changed FROM scores a JOIN b USING (i)")
def jn16(spark, d):
    s = scores(spark, d)
    b = s.selectExpr("i", "CASE WHEN k % 11 = 0 THEN NULL ELSE intent END AS intent")
    return J.aligned(s, b, "i", ["intent"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("same")).alias("changed"))


_FA = "bucket <> 'target_commands' AND intent IS NOT NULL"


@add("jn17_set_algebra", S + f", f AS (SELECT i, coalesce({_FA} AND confidence >= 0.9, FALSE) AS a, coalesce({_FA} AND (gap IS NULL OR gap >= 2), FALSE) AS b FROM scores) SELECT count(*) FILTER (a AND NOT b) AS removed, count(*) FILTER (b AND NOT a) AS added, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither FROM f")
def jn17(spark, d):
    s = scores(spark, d)
    return J.set_algebra(s.where(f"{_FA} AND confidence >= 0.9"), s.where(f"{_FA} AND (gap IS NULL OR gap >= 2)"), s, "i")
