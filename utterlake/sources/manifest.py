"""Scans, checks and sinks of manifests and score files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kept import keep


class BadTable(ValueError):
    """A table lacks columns, has too few or too many rows, or repeats a key."""


def kept_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value, q, blank: the lines of text files, and the number of quotes in each. How files are cut into blocks depends on the cores of the moment, so they are scanned once, and the lines are written with their block."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # the number of a line rises within a block, not from block to block
    line = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    return keep(spark.read.option("lineSep", "\n").text(path).select(*line, "value", quotes.alias("q"), F.col("value").isin("", "\r").alias("blank")), "lines")


def numbered(lines: DataFrame) -> DataFrame:
    """kept_lines of CSV files, whose quoted cells may hold line breaks, with at, n and opener: `at` is the number of a line's record among the n that begin in its block, and 0 where it goes on with the last record of the block `opener`.

    A line belongs to the record before it if the quotes of the file so far are odd in number. Records are numbered within a block for both cases, and the quotes of earlier blocks tell which one holds.
    """
    block = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    odd = F.pmod(F.coalesce(F.sum("q").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(2))
    x = lines.withColumn("odd", odd).withColumn("at0", F.sum(1 - F.col("odd")).over(block)).withColumn("at1", F.sum("odd").over(block))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    per = x.groupBy("file", "block").agg(F.sum("q").alias("q"), F.max("at0").alias("n0"), F.max("at1").alias("n1"))
    per = per.withColumn("inside", F.pmod(F.coalesce(F.sum("q").over(earlier), F.lit(0)), F.lit(2)) == 1).withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")))
    per = per.withColumn("opener", F.last(F.when(F.col("n") > 0, F.col("block")), ignorenulls=True).over(earlier))
    at = F.when(F.col("inside"), F.col("at1")).otherwise(F.col("at0"))
    return x.join(per.select("file", "block", "inside", "n", "opener"), ["file", "block"]).select("file", "block", "line", "value", "blank", at.alias("at"), "n", "opener")


def joined(*by: str) -> Column:
    """The texts of a group, the last column, as lines in order of the columns."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by))), lambda s: s[by[-1]]), "\n")


def quoted_records(lines: DataFrame) -> DataFrame:
    """file, block, at, text: the records of numbered lines by the block that they begin in, blank ones left out. Lines meet by block; what later blocks add to a block's last record is joined to it."""
    pieces = lines.groupBy("file", "block", "at", "n", "opener").agg(joined("line", "value").alias("text"))
    rest = pieces.where("at = 0").groupBy("file", F.col("opener").alias("block")).agg(joined("block", "text").alias("rest"))
    x = pieces.where((F.col("at") > 0) & ~F.col("text").isin("", "\r")).join(rest, ["file", "block"], "left")
    text = F.when((F.col("at") == F.col("n")) & F.col("rest").isNotNull(), F.concat_ws("\n", "text", "rest")).otherwise(F.col("text"))
    return x.select("file", "block", "at", F.regexp_replace(text, "\r\\z", "").alias("text"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC1: header CSV with quoted free text, line breaks within it; empty cells are null, quoted empty ones empty strings where the schema has a string; typed by a fixed schema. Large files are many tasks. A header that names other columns, and a table without rows, are errors."""
    typed = T._parse_datatype_string(schema)
    names = [f.name for f in typed.fields]
    # a null that no cell spells: else a quoted empty cell is one too; \0 is spelled otherwise for the parser, which drops it from quoted cells
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "lineSep": "\u0001", "maxCharsPerColumn": "-1", "nullValue": uuid.uuid4().hex, "emptyValue": ""}
    spelled = lambda c: F.replace(F.replace(c, F.lit("\u0002"), F.lit("\u0002a")), F.lit("\0"), F.lit("\u0002b"))
    restored = lambda c: F.replace(F.replace(c, F.lit("\u0002b"), F.lit("\0")), F.lit("\u0002a"), F.lit("\u0002"))
    cells = lambda text: F.from_csv(spelled(F.col(text)), ", ".join(f"c{i} string" for i in range(len(names))) + ", more string", options).alias("r")
    lines, breaks = kept_lines(spark, path), sum(name.count("\n") for name in names)
    first = lines.where("block = 0").withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("i") <= 1 + breaks)
    heads = first.groupBy("file").agg(F.regexp_replace(joined("line", "value"), "\r\\z", "").alias("text"), (F.sum("q") % 2 == 1).alias("open")).where("text != ''")
    heads = heads.select(cells("text"), "open").select("r.*", "open").distinct().limit(2).collect()
    if not heads:
        raise BadTable(f"{path} is empty")
    if len(heads) > 1 or [*heads[0]][: len(names)] != names or heads[0]["more"] is not None or heads[0]["open"]:
        raise BadTable(f"{path} has other columns than {names}")
    lines, head = numbered(lines), (F.col("block") == 0) & (F.col("at") == 1)
    if lines.where(~head & (F.col("at") > 0) & ~F.col("blank")).isEmpty():
        raise BadTable(f"{path} has no rows")
    body, out = quoted_records(lines).where(~head).select(cells("text")).select("r.*"), []
    for i, f in enumerate(typed.fields):
        c = restored(F.col(f"c{i}")) if f.dataType == T.StringType() else F.nullif(F.col(f"c{i}"), F.lit(""))
        out.append((F.when(c.isNotNull(), c == "True") if f.dataType == T.BooleanType() else c.cast(f.dataType)).alias(f.name))
    return body.select(*out)


def write_manifest(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """SC10: fixed column order, sorted over all files (range by range), published by renaming a staged folder. Texts keep the blanks at their ends; a null is an empty cell, an empty string a quoted one."""
    spark = df.sparkSession
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    cells = [F.when(F.col(c), "True").when(~F.col(c), "False").alias(c) if df.schema[c].dataType == T.BooleanType() else F.col(c) for c in columns]
    df.select(*columns).orderBy(*order).select(*cells).write.csv(staged, header=True, quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(b):
        raise BadTable(f"{path} is published already")
    if not fs.rename(a, b):
        raise OSError(f"cannot publish {path}")


def write_plan(df: DataFrame, path: str, by: str) -> None:
    """SC11: gzip CSV, null as an empty cell, one folder a value of `by`."""
    df.write.partitionBy(by).option("compression", "gzip").option("nullValue", "").csv(path, header=True)


def check_table(df: DataFrame, required: list[str], least: int, most: int) -> DataFrame:
    """SC2: df itself, or an error naming missing columns or the row count outside the band."""
    if missing := [c for c in required if c not in df.columns]:
        raise BadTable(f"missing columns: {missing}")
    n = df.count()
    if not least <= n <= most:
        raise BadTable(f"{n} rows, expected {least} to {most}")
    return df


def import_shards(spark: SparkSession, glob: str, split_pattern: str, skip: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """SC3: Parquet shards with the split from the file name; kept rows, and counts of the first skip reason by split."""
    rows = spark.read.parquet(glob).withColumn("shard_split", F.regexp_extract(F.input_file_name(), split_pattern, 1))
    reason = F.lit(None).cast("string")
    for name, rule in reversed(skip):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    rows = rows.withColumn("_skip", reason)
    return rows.where("_skip IS NULL").drop("_skip"), rows.where("_skip IS NOT NULL").groupBy("shard_split", F.col("_skip").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def adapt(sources: dict[str, tuple[DataFrame, dict[str, Column], Column | None]], columns: list[str]) -> DataFrame:
    """SC4: corpora of different columns to one candidate schema: (table, column expressions, filter) each; expressions that are absent are null."""
    parts = []
    for name, (df, exprs, keep) in sources.items():
        x = df if keep is None else df.where(keep)
        parts.append(x.select(F.lit(name).alias("source"), *[exprs.get(c, F.lit(None)).alias(c) for c in columns]))
    return reduce(DataFrame.unionByName, parts)


def read_jsonl(spark: SparkSession, glob: str, schema: str, order: str) -> tuple[DataFrame, DataFrame]:
    """SC5: sharded JSON lines of a fixed schema in order of a row number; and the malformed lines with their file."""
    lines = spark.read.text(glob).where(F.trim("value") != "").withColumn("file", F.input_file_name())
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("row IS NOT NULL AND row._bad IS NULL").select("row.*").drop("_bad")
    return good.orderBy(order), parsed.where("row IS NULL OR row._bad IS NOT NULL").select("file", F.col("value").alias("line"))


def merge_shards(parts: list[DataFrame], key: str) -> DataFrame:
    """SC6: union of shard manifests; a key in two shards is an error."""
    out = reduce(DataFrame.unionByName, parts)
    twice = [r[0] for r in out.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()]
    if twice:
        raise BadTable(f"{key} in several shards: {twice}")
    return out


def hash_files(spark: SparkSession, glob: str) -> DataFrame:
    """SC7: path, length, md5 and sha256 of every file."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def parse_report(reports: DataFrame, file: str, text: str) -> DataFrame:
    """SC8: flagged names of Markdown reports: table rows between '## Flagged' and the next heading, escaped bars restored, header and rule dropped."""
    from ..operators.frames import fill_section

    lines = reports.select(file, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    x = fill_section(lines, file, "pos", F.when(F.col("line").startswith("## "), F.substring("line", 4, 200)))
    cell = F.trim(F.split(F.regexp_replace("line", "\\\\\\|", "\u0001"), "\\|")[1])
    rows = x.where((F.col("section") == "Flagged") & F.col("line").startswith("|")).select(file, F.replace(cell, F.lit("\u0001"), F.lit("|")).alias("name"))
    return rows.where(~F.col("name").rlike("^(-+|name)$"))


NAME = r"^([A-Z_]+)_s([0-9]+)_p([0-9]+)_v([0-9]+)\.wav$"


def decode_name(c: Column) -> list[Column]:
    """SC9: intent, speaker, phrase and variant of a file name, and whether it has that form; take names without a number are take 1."""
    ok = c.rlike(NAME)
    num = lambda g: F.when(ok, F.regexp_extract(c, NAME, g).try_cast("int"))
    return [F.when(ok, F.regexp_extract(c, NAME, 1)).alias("intent"), num(2).alias("speaker"), num(3).alias("phrase"), num(4).alias("variant"), ok.alias("ok"), F.coalesce(F.regexp_extract(c, r"take ?([0-9]+)", 1).try_cast("int"), F.lit(1)).alias("take")]


def enriched_export(rows: DataFrame, jobs: DataFrame, qa: DataFrame, rescued: DataFrame, manifest: DataFrame) -> DataFrame:
    """SC12: published rows (name) with job_id, qa_passed, qa_rescued and manifest_split."""
    x = rows.join(jobs.select("name", "job_id"), "name", "left").join(qa.select("job_id", F.col("passed").alias("qa_passed")), "job_id", "left")
    x = x.join(rescued.select("name").distinct().withColumn("qa_rescued", F.lit(True)), "name", "left")
    return x.join(manifest.select("name", F.col("split").alias("manifest_split")), "name", "left").withColumn("qa_rescued", F.coalesce("qa_rescued", F.lit(False)))


def summary_table(counts: DataFrame, row: str, column: str, values: list[str], n: str) -> DataFrame:
    """SC13: Markdown lines of a count table, one a row value; `values` are the columns."""
    p = counts.groupBy(row).agg(*[F.coalesce(F.sum(F.when(F.col(column) == v, F.col(n))), F.lit(0)).alias(f"_{i}") for i, v in enumerate(values)])
    return p.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col(row), *[F.col(f"_{i}").cast("string") for i in range(len(values))]), F.lit(" |")).alias("line"))
