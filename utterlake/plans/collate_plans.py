"""Queries of collation, set operations and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text, spell_numbers
from ..operators import collate as V
from ..operators import metrics as M
from .common import CLIPS, SCORES, Book, clips, scores, table
from .metric_plans import GRID, SWEEP_SQL, TARGET
from .text_plans import N1

BOOK = Book()
add = BOOK.add
C, S = f"WITH {CLIPS}", f"WITH {SCORES}"


@add("so1_widened_union", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def so1(spark, d):
    return V.widened_union([table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))], ["id", "name", "seg"])


@add("so2_symmetric_difference", "(SELECT p_name, p_type, 'a' AS side FROM (SELECT p_name, p_type FROM part WHERE p_partkey % 3 < 2 EXCEPT ALL SELECT p_name, p_type FROM part WHERE p_partkey % 3 > 0)) UNION ALL (SELECT p_name, p_type, 'b' FROM (SELECT p_name, p_type FROM part WHERE p_partkey % 3 > 0 EXCEPT ALL SELECT p_name, p_type FROM part WHERE p_partkey % 3 < 2))")
def so2(spark, d):
    p = table(spark, d, "part")
    return V.symmetric_difference(p.where("p_partkey % 3 < 2"), p.where("p_partkey % 3 > 0"), ["p_name", "p_type"])


@add("so3_set_counts", "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both")
def so3(spark, d):
    x = table(spark, d, "lineitem")
    return V.set_counts(x.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), x.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey"))


@add("so4_row_fingerprint", "WITH h AS (SELECT md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus)) AS h FROM orders) SELECT count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS f1, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS f2 FROM h")
def so4(spark, d):
    return V.fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@add("cv1_collate", C + " SELECT doc_id, '../base/' || path AS path, FALSE AS added FROM clips WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, path, TRUE FROM clips WHERE doc_id % 2 = 1")
def cv1(spark, d):
    c = clips(spark, d).select("doc_id", "path")
    return V.collate(c.where("doc_id % 2 = 0").withColumn("added", F.lit(False)), c.where("doc_id % 2 = 1").withColumn("added", F.lit(True)), "path", F.concat(F.lit("../base/"), "path"))


@add("cv2_row_expansion", C + ", x AS (SELECT doc_id, filename, source_dataset, unnest(CASE WHEN doc_id % 3 = 0 THEN ['', '_noisy'] ELSE [''] END) AS s FROM clips) SELECT doc_id, filename || s AS filename, source_dataset || s AS source_dataset, s <> '' AS is_noisy FROM x")
def cv2(spark, d):
    return V.expand(clips(spark, d).select("doc_id", "filename", "source_dataset"), F.col("doc_id") % 3 == 0, "filename", "source_dataset")


@add("cv3_control_pair", C + ", k AS (SELECT * FROM clips WHERE NOT (source_dataset LIKE '%ambient' AND split = 'train')) SELECT (SELECT count(*) FROM clips) AS treatment, (SELECT count(*) FROM k) AS control, (SELECT count(*) FROM (SELECT doc_id FROM clips WHERE split <> 'train' EXCEPT ALL SELECT doc_id FROM k WHERE split <> 'train')) AS held_out_diff")
def cv3(spark, d):
    t, c = V.control_pair(clips(spark, d), F.col("source_dataset").endswith("ambient"), "split")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(t, "treatment").crossJoin(n(c, "control")).crossJoin(n(V.held_out_difference(t, c, "split", ["doc_id"]), "held_out_diff"))


@add("cv4_train_only", C + " SELECT doc_id, split FROM clips WHERE source_dataset LIKE '%ambient' AND split <> 'train'")
def cv4(spark, d):
    return V.train_only(clips(spark, d).where(F.col("source_dataset").endswith("ambient")).select("doc_id", "split"), "split")


@add("cv5_group_disjointness", C + " SELECT bucket, group_id, count(DISTINCT split) AS splits FROM clips WHERE group_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def cv5(spark, d):
    return V.group_leaks(clips(spark, d), "bucket", "group_id", "split")


@add("cv6_share_assertion", C + " SELECT split, avg((doc_id % 2 = 0)::INT) AS share, abs(avg((doc_id % 2 = 0)::INT) - 0.5) <= 0.01 AS ok FROM clips GROUP BY 1")
def cv6(spark, d):
    return V.share_check(clips(spark, d), "split", F.col("doc_id") % 2 == 0, 0.5, 0.01)


@add("cv7_duplicate_keys", "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def cv7(spark, d):
    return V.duplicate_keys(table(spark, d, "documents").select(F.md5("text").alias("h")), ["h"])


@add("cv8_file_existence", C + " SELECT path, doc_id FROM clips WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cv8(spark, d):
    listing = table(spark, d, "labels").join(clips(spark, d).select("doc_id", "path"), "doc_id").select("path")
    return V.absent(clips(spark, d).select("path", "doc_id"), listing, "path")


@add("cv9_encodability", "SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), '^[a-z '']*$')")
def cv9(spark, d):
    return V.unencodable(table(spark, d, "documents"), F.lower("text")).select("doc_id")


@add("cv10_length_feasibility", f"SELECT doc_id, floor(n_chars / 20.0 * 16000 / 160) + 1 >= length(t) + len(list_filter(range(1, length(t)), lambda i: t[i:i] = t[i+1:i+1])) AS ok FROM (SELECT doc_id, n_chars, {N1.format('text')} AS t FROM documents)")
def cv10(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars", normalize_text(F.col("text")).alias("t"))
    return t.select("doc_id", V.length_feasible(F.col("t"), F.col("n_chars") / 20.0).alias("ok"))


@add("cv11_format_invariants", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'F' OR l_tax <> 0.02")
def cv11(spark, d):
    return V.format_breaks(table(spark, d, "lineitem"), {"l_linestatus": "F", "l_tax": 0.02}).select("l_orderkey", "l_linenumber")


@add("cv12_consolidate", "SELECT 'web' AS subset, (SELECT count(*) FROM pages) AS n UNION ALL SELECT 'bench', (SELECT count(*) FROM benchmark) UNION ALL SELECT 'gone', 0")
def cv12(spark, d):
    web, bench = table(spark, d, "pages").select(F.col("url").alias("path")), table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"))
    return V.consolidate({"web": web, "bench": bench, "gone": None}, "path", spark)[1]


@add("cv13_licence_cover", "WITH w AS (SELECT l_partkey AS file, count(*) AS n, max(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS r FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT p_partkey AS file, coalesce(n, 0) AS waivers, CASE r WHEN 1 THEN 'N' WHEN 2 THEN 'A' WHEN 3 THEN 'R' END AS licence FROM part LEFT JOIN w ON file = p_partkey")
def cv13(spark, d):
    w = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("file"), F.col("l_returnflag").alias("licence"))
    return V.licence_cover(table(spark, d, "part").select(F.col("p_partkey").alias("file")), w, ["N", "A", "R"])


@add("cv14_rebuild_check", "(SELECT o_orderkey, 'a' AS side FROM orders WHERE o_orderkey % 100 = 0)")
def cv14(spark, d):
    o = table(spark, d, "orders")
    return V.symmetric_difference(o, o.where("o_orderkey % 100 <> 0"), ["o_orderkey"])


@add("cv15_phase_guards", "SELECT DISTINCT 'o_orderstatus' AS field, o_orderstatus AS found FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority <> '2-HIGH'")
def cv15(spark, d):
    return V.phase_guard(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})


@add("cv16_expected_vs_got", "WITH g AS (SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS n FROM events) SELECT e.metric, CASE WHEN value IS NULL THEN 'MISSING' WHEN want IS NOT NULL THEN CASE WHEN value = want THEN 'PASS' ELSE 'FAIL' END WHEN value BETWEEN lo AND hi THEN 'WITHIN' ELSE 'OUTSIDE' END AS status, CASE WHEN want IS NOT NULL THEN value - want END AS delta FROM (SELECT 'click' AS metric, n / 5 AS want, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM t UNION ALL SELECT 'view', NULL, n * 0.15, n * 0.25 FROM t UNION ALL SELECT 'error', NULL, n * 0.5, n FROM t UNION ALL SELECT 'gone', 1, NULL, NULL FROM t) e LEFT JOIN g USING (metric)")
def cv16(spark, d):
    e = table(spark, d, "events")
    got = e.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    n = F.count(F.lit(1)).cast("double")
    nil = F.lit(None).cast("double")
    want = e.agg(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), lo.alias("lo"), hi.alias("hi")) for m, v, lo, hi in (("click", n / 5, nil, nil), ("view", nil, n * 0.15, n * 0.25), ("error", nil, n * 0.5, n), ("gone", F.lit(1.0), nil, nil))]).alias("w"))
    return V.expected_check(got, want.select(F.inline("w")))


@add("cv17_qa_rescue", f"WITH x AS (SELECT p_partkey, p_name || ' 7 percent' AS want, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', 7%!' ELSE ' 8%' END AS heard FROM part WHERE p_size > 25) SELECT p_partkey FROM x WHERE {N1.format('replace(replace(replace(heard, chr(37), chr(32) || chr(112) || substr(want, length(want) - 5)), chr(55), ' + chr(39) + 'seven' + chr(39) + '), chr(56), ' + chr(39) + 'eight' + chr(39) + ')')} = {N1.format('replace(want, chr(55), ' + chr(39) + 'seven' + chr(39) + ')')}")
def cv17(spark, d):
    p = table(spark, d, "part").where("p_size > 25").select("p_partkey", F.concat("p_name", F.lit(" 7 percent")).alias("want"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ", 7%!").otherwise(" 8%")).alias("heard"))
    said = lambda c: normalize_text(spell_numbers(F.replace(F.col(c), F.lit("%"), F.lit(" percent"))))
    return V.rescued(p, said("heard"), said("want")).select("p_partkey")


@add("cv18_eval_manifest", C + ", x AS (SELECT doc_id, split, bucket, CASE WHEN doc_id % 2 = 0 THEN 'exact_text' ELSE 'near' END AS m FROM clips) SELECT doc_id, bucket FROM x WHERE split IN ('val', 'test') AND (bucket <> 'target_commands' OR m LIKE 'exact%') UNION ALL SELECT item_id, 'noise' FROM benchmark")
def cv18(spark, d):
    x = clips(spark, d).select("doc_id", "split", "bucket", F.when(F.col("doc_id") % 2 == 0, "exact_text").otherwise("near").alias("m"))
    noise = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("noise").alias("bucket"))
    return V.eval_manifest(x, noise, ["val", "test"], "m").select("doc_id", "bucket")


@add("cv19_recompute_check", S + f", {SWEEP_SQL} SELECT threshold FROM sweep WHERE threshold > 0.95")
def cv19(spark, d):
    fresh = M.sweep(scores(spark, d).where("split = 'val'"), GRID, TARGET())
    saved = fresh.withColumn("ta", F.col("ta") + F.when(F.col("threshold") > 0.95, 1).otherwise(0))
    return V.recomputed(saved, fresh, "threshold", ["target_rate", "false_rate"], ["ta", "fa"])


@add("cv20_supplement_append", "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus <> 'F' THEN 'voice_split' WHEN l_linenumber = 1 THEN 'no_variation' END AS reason FROM lineitem) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1")
def cv20(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("voice_split"))
    kept, skipped = V.supplement(x, "voice_split", F.when(F.col("l_linenumber") == 1, "dropped").otherwise("command"), F.lit("train"))
    return kept.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")).unionByName(skipped)


@add("cv21_probe_sets", "WITH r AS (SELECT event_id AS id, props FROM events WHERE event_type = 'click'), n AS (SELECT item_id AS id, NULL::VARCHAR AS props FROM benchmark) SELECT 'raw' AS probe, id, json_extract_string(props, '$.k')::INT AS slot FROM (SELECT * FROM r UNION ALL SELECT * FROM n) UNION ALL SELECT 'derived', id, json_extract_string(props, '$.k')::INT FROM (SELECT * FROM r WHERE id % 4 > 0 UNION ALL SELECT * FROM n)")
def cv21(spark, d):
    raw = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"), "props")
    noise = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    slot = F.from_json("props", "k int")["k"]
    return V.probe_sets(raw, raw.where("id % 4 > 0"), noise, slot).select("probe", "id", "slot")


@add("cv22_candidate_pool", "WITH g AS (SELECT p_partkey FROM part WHERE p_size < 20 UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS origin FROM part) SELECT p_type, origin, count(*) AS n FROM u WHERE p_partkey IN (SELECT p_partkey FROM g) GROUP BY 1, 2")
def cv22(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    rescue = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return V.candidate_pool(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), p.where("p_size < 20"), rescue, "p_partkey", "p_type")
