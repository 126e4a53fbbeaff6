"""Queries of scans, sinks and plug points. What a scan needs as files is written from the given tables to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import plug as P
from ..functions.scoring import accepted
from ..sources import manifest as A
from ..streaming.folder import shared_dir
from .common import CLIPS, SCORES, Book, clips, scores, table
from .metric_plans import SWEEP_SQL
from .text_plans import PHRASES, phrases

BOOK = Book()
add = BOOK.add
C, S = f"WITH {CLIPS}", f"WITH {SCORES}"


def place(spark) -> str:
    return f"{shared_dir(spark)}/sources/{uuid.uuid4().hex}"


@add("sc1_manifest_scan", C + " SELECT path, label, duration::DOUBLE AS duration, group_id, doc_id % 2 = 0 AS resampled, md5(transcript) AS said FROM clips")
def sc1(spark, d):
    out = place(spark)
    c = clips(spark, d).withColumn("resampled", F.col("doc_id") % 2 == 0)
    A.write_manifest(c, out, ["path", "label", "duration", "group_id", "resampled", "transcript"], ["label", "path"])
    m = A.read_manifest(spark, out, "path string, label string, duration double, group_id string, resampled boolean, transcript string")
    return m.select("path", "label", "duration", "group_id", "resampled", F.md5("transcript").alias("said"))


@add("sc2_table_check", "SELECT count(*) AS n FROM orders")
def sc2(spark, d):
    return A.check_table(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], 1, 10**12).agg(F.count(F.lit(1)).alias("n"))


@add("sc3_shard_import", "SELECT lang AS shard_split, CASE WHEN n_chars < 300 THEN 'short' WHEN doc_id % 9 = 0 THEN 'ninth' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2")
def sc3(spark, d):
    out = place(spark)
    table(spark, d, "documents").select("doc_id", "n_chars", F.col("lang").alias("part")).write.partitionBy("part").parquet(out)
    kept, skipped = A.import_shards(spark, f"{out}/part=*", r"part=(\w+)/", [("short", F.col("n_chars") < 300), ("ninth", F.col("doc_id") % 9 == 0)])
    return skipped.unionByName(kept.groupBy("shard_split").agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n")))


@add("sc4_source_adapter", "SELECT 'docs' AS source, doc_id AS id, 'docs/' || doc_id AS path, n_chars / 1000.0::DOUBLE AS duration, lang AS tag FROM documents WHERE lang <> 'es' UNION ALL SELECT 'pages', page_id, url, NULL, NULL FROM pages UNION ALL SELECT 'bench', item_id, NULL, length(text) / 1000.0::DOUBLE, 'gold' FROM benchmark")
def sc4(spark, d):
    c = F.col
    return A.adapt(
        {
            "docs": (table(spark, d, "documents"), {"id": c("doc_id"), "path": F.concat(F.lit("docs/"), c("doc_id")), "duration": (c("n_chars") / 1000.0), "tag": c("lang")}, c("lang") != "es"),
            "pages": (table(spark, d, "pages"), {"id": c("page_id"), "path": c("url")}, None),
            "bench": (table(spark, d, "benchmark"), {"id": c("item_id"), "duration": F.length("text") / 1000.0, "tag": F.lit("gold")}, None),
        },
        ["id", "path", "duration", "tag"],
    )


@add("sc5_jsonl_scan", S + " SELECT i, intent, confidence::DOUBLE AS confidence, FALSE AS bad FROM scores UNION ALL SELECT i, NULL, NULL, TRUE FROM scores WHERE i % 10 = 3")
def sc5(spark, d):
    out = place(spark)
    lines = scores(spark, d).select("split", F.to_json(F.struct("i", "intent", "confidence")).alias("line"))
    broken = scores(spark, d).where("i % 10 = 3").select("split", F.concat(F.lit('{"i": '), F.col("i").cast("string"), F.lit(", broken")).alias("line"))
    lines.unionByName(broken).write.partitionBy("split").text(out)
    rows, bad = A.read_jsonl(spark, f"{out}/split=*/*.txt", "i long, intent string, confidence double", "i")
    return rows.select("i", "intent", "confidence", F.lit(False).alias("bad")).unionByName(bad.select(F.regexp_extract("line", "([0-9]+)", 1).cast("long").alias("i"), F.lit(None).cast("string").alias("intent"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("bad")))


@add("sc6_shard_merge", "SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders")
def sc6(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    return A.merge_shards([o.where(f"job_id % 3 = {i}") for i in range(3)], "job_id")


@add("sc7_file_hashes", "SELECT item_id::BIGINT AS item_id, octet_length(encode(text || chr(10)))::BIGINT AS length, md5(text || chr(10)) AS md5, sha256(text || chr(10)) AS sha256 FROM benchmark")
def sc7(spark, d):
    out = place(spark)
    table(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(out)
    return A.hash_files(spark, f"{out}/*/*.txt").select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "length", "md5", "sha256")


_REPORT = "concat('# Report ', c_custkey, '\\n\\n## Passed\\n| name | why |\\n| x.wav | ok |\\n## Flagged\\n| name | why |\\n|---|---|\\n| a', c_custkey, '.wav | noise |\\n| b\\\\|', c_nationkey, '.wav | text |\\n\\n## End\\n| y.wav | z |')"


@add("sc8_report_parse", "SELECT c_custkey, 'a' || c_custkey || '.wav' AS name FROM customer UNION ALL SELECT c_custkey, 'b|' || c_nationkey || '.wav' FROM customer")
def sc8(spark, d):
    return A.parse_report(table(spark, d, "customer").selectExpr("c_custkey", f"{_REPORT} AS text"), "c_custkey", "text")


_FILE = "CASE WHEN l_linenumber = 1 THEN concat('my take ', l_suppkey, '.wav') WHEN l_linenumber = 2 THEN 'other.wav' ELSE concat('LIGHTS_', l_returnflag, '_s', l_suppkey, '_p', l_partkey % 93, '_v', l_linenumber, '.wav') END"


@add("sc9_name_decode", f"WITH x AS (SELECT l_orderkey, l_linenumber, {_FILE} AS f, l_linenumber > 2 AS ok, l_returnflag, l_suppkey, l_partkey FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN 'LIGHTS_' || l_returnflag END AS intent, CASE WHEN ok THEN l_suppkey::INT END AS speaker, CASE WHEN ok THEN (l_partkey % 93)::INT END AS phrase, CASE WHEN ok THEN l_linenumber::INT END AS variant, ok, CASE WHEN l_linenumber = 1 THEN l_suppkey::INT ELSE 1 END AS take FROM x")
def sc9(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_FILE} AS f")
    return x.select("l_orderkey", "l_linenumber", *A.decode_name(F.col("f")))


@add("sc10_manifest_sink", C + " SELECT path, bucket, label FROM clips WHERE bucket <> 'silence'")
def sc10(spark, d):
    out = place(spark)
    A.write_manifest(clips(spark, d).where("bucket <> 'silence'"), out, ["path", "bucket", "label"], ["bucket", "label", "path"])
    return A.read_manifest(spark, out, "path string, bucket string, label string")


@add("sc11_plan_sink", S + " SELECT i, gap::DOUBLE AS gap, split FROM scores")
def sc11(spark, d):
    out = place(spark)
    A.write_plan(scores(spark, d).select("i", "gap", "split"), out, "split")
    return spark.read.csv(out, header=True, schema="i long, gap double, split string")


@add("sc12_enriched_export", "SELECT p_partkey AS name, s_suppkey AS job_id, s_acctbal > 0 AS qa_passed, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS qa_rescued, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS manifest_split FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def sc12(spark, d):
    p = table(spark, d, "part")
    s = table(spark, d, "supplier")
    return A.enriched_export(
        p.select(F.col("p_partkey").alias("name")), s.select(F.col("s_suppkey").alias("name"), F.col("s_suppkey").alias("job_id")), s.select(F.col("s_suppkey").alias("job_id"), (F.col("s_acctbal") > 0).alias("passed")),
        table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("name")), p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("split")),
    )


@add("sc13_text_summary", C + " SELECT '| ' || label || ' | ' || count(*) FILTER (split = 'train') || ' | ' || count(*) FILTER (split = 'val') || ' | ' || count(*) FILTER (split = 'test') || ' |' AS line FROM clips GROUP BY label")
def sc13(spark, d):
    c = clips(spark, d).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))
    return A.summary_table(c, "label", "split", ["train", "val", "test"], "n")


@add("st11_target_labelling", f"WITH {PHRASES}, x AS (SELECT p_partkey, p_size, CASE WHEN p_size <= 20 THEN concat('make it ', lower(p_type), CASE WHEN length(p_type) > 5 THEN concat(' ', p_size) ELSE '' END) ELSE p_name END AS text, CASE WHEN p_partkey % 7 = 0 THEN 'OTHER' WHEN p_partkey % 5 = 0 THEN 'ECONOMY' ELSE upper(p_type) END AS label, CASE WHEN p_partkey % 4 = 0 THEN 'babble' ELSE 'target_commands' END AS bucket, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS sv FROM part), p AS (SELECT text, min(intent) AS i, min(value) AS v FROM phrases GROUP BY 1), y AS (SELECT x.*, v, CASE WHEN bucket <> 'target_commands' THEN 'nontarget' WHEN label NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'LARGE', 'STANDARD') THEN 'intent_unmapped' WHEN label NOT IN (SELECT intent FROM phrases WHERE slot IS NOT NULL) THEN 'nonslotted' WHEN i IS NOT NULL AND i <> label THEN 'phrase_label_mismatch' WHEN v IS NOT NULL THEN 'phrase' WHEN sv IS NOT NULL THEN 'manifest_slot_value' ELSE 'no_slot_target' END AS reason FROM x LEFT JOIN p ON p.text = x.text) SELECT p_partkey, reason, CASE reason WHEN 'phrase' THEN v WHEN 'manifest_slot_value' THEN sv END AS slot FROM y")
def st11(spark, d):
    x = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size <= 20 THEN concat('make it ', lower(p_type), CASE WHEN length(p_type) > 5 THEN concat(' ', p_size) ELSE '' END) ELSE p_name END AS text", "CASE WHEN p_partkey % 7 = 0 THEN 'OTHER' WHEN p_partkey % 5 = 0 THEN 'ECONOMY' ELSE upper(p_type) END AS label", "CASE WHEN p_partkey % 4 = 0 THEN 'babble' ELSE 'target_commands' END AS bucket", "CASE WHEN p_partkey % 2 = 0 THEN cast(p_size AS string) END AS slot_value")
    return P.target_label(x, phrases(spark, d), ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "LARGE", "STANDARD"]).select("p_partkey", "reason", "slot")


@add("st14_slot_truth", "WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE p_name END AS own, CASE WHEN p_size % 2 = 0 THEN 'on' END AS dict FROM part), v AS (SELECT p_partkey, coalesce(nullif(trim(own), ''), dict) AS v FROM x) SELECT p_partkey, v AS slot, v IS NOT NULL AND NOT regexp_matches(v, '^([0-9]+|on|off)') AS unparseable FROM v")
def st14(spark, d):
    x = table(spark, d, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE p_name END AS own", "CASE WHEN p_size % 2 = 0 THEN 'on' END AS dict")
    value, bad = P.slot_truth(F.col("own"), F.col("dict"))
    return x.select("p_partkey", value.alias("slot"), bad.alias("unparseable"))


@add("ar8_score_transforms", S + " SELECT i, round(value / nullif(k, 0), 6) AS per_frame, round(value / nullif(k % 5, 0), 6) AS per_symbol, round(value - coalesce(gap, 0), 6) AS lead, round(abs(value) - abs(gap), 6) AS greedy_gap FROM scores")
def ar8(spark, d):
    x = P.transforms(scores(spark, d).withColumn("n", F.col("k") % 5), "value", "k", "n", "gap")
    return x.select("i", *[F.round(c, 6).alias(c) for c in ("per_frame", "per_symbol", "lead", "greedy_gap")])


@add("jn14_grid_join", S + f", {SWEEP_SQL} SELECT threshold, ta, fa FROM sweep")
def jn14(spark, d):
    from .metric_plans import GRID

    s = scores(spark, d).where("split = 'val'")
    grid = spark.createDataFrame([(g,) for g in GRID], "threshold double")
    per = s.groupBy((F.col("bucket") == "target_commands").alias("t"), "intent", "confidence").agg(F.count(F.lit(1)).alias("n"))
    ok = accepted(F.col("intent"), F.col("confidence"), F.col("threshold"))
    total = lambda c: F.coalesce(F.sum(F.when(c & ok, F.col("n"))), F.lit(0))
    return per.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(total(F.col("t")).alias("ta"), total(~F.col("t")).alias("fa"))


@add("ud1_plug_points", S + " SELECT i, CASE WHEN k % 2 = 0 THEN intent ELSE label END AS predicted, coalesce((CASE WHEN k % 2 = 0 THEN intent ELSE label END) <> 'unknown' AND confidence > 0.8, FALSE) AS accepted FROM scores")
def ud1(spark, d):
    out = P.evaluate(scores(spark, d), lambda: F.when(F.col("k") % 2 == 0, F.col("intent")).otherwise(F.col("label")), lambda p: (p != "unknown") & (F.col("confidence") > 0.8))
    return out.select("i", "predicted", "accepted")


@add("ud2_keyed_fold", "SELECT user_id, (sum(CASE WHEN value > 50 THEN 1 ELSE -1 END))::INT AS state FROM events GROUP BY 1")
def ud2(spark, d):
    return P.fold(table(spark, d, "events"), "user_id", ["event_id", "value"], F.lit(0), lambda acc, x: acc + F.when(x["value"] > 50, 1).otherwise(-1))


@add("ud3_saved_threshold", "SELECT round(max(value), 6) AS threshold, TRUE AS found FROM events WHERE event_type = 'click'")
def ud3(spark, d):
    report = table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.max("value").alias("value"))
    return P.saved_threshold(report, "click", 0.5).withColumn("threshold", F.round("threshold", 6))
