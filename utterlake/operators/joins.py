"""Lookup, gate, leak and interval joins. All are equi joins or ordered unions; none is a nested loop over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingRows(ValueError):
    """A mandatory match is absent, or a key that must be unique is not."""


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by `order`."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def lookup(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """JN1: left join with a column `missed`."""
    return df.join(side.withColumn("_hit", F.lit(True)), key, "left").withColumn("missed", F.col("_hit").isNull()).drop("_hit")


def mandatory(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """JN2: inner join that raises, naming some keys, where a row of df has no match."""
    lost = [r[0] for r in df.join(side.select(key), key, "left_anti").select(key).distinct().limit(3).collect()]
    if lost:
        raise MissingRows(f"no match for {key} in {lost}")
    return df.join(side, key)


def polymorphic(df: DataFrame, tables: dict[str, DataFrame], constants: dict[str, str | None]) -> DataFrame:
    """JN3: transcript by source: from the source's table (base, transcript), a constant, or null; an _ambient suffix does not count. `known` false: no rule for the source."""
    src = F.regexp_replace("source_dataset", "_ambient$", "")
    union = reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("_from"), F.col("base").alias("_base"), F.col("transcript").alias("_said")) for name, t in tables.items()])
    out = df.withColumn("_src", src).join(union, (F.col("_src") == F.col("_from")) & (F.col("base") == F.col("_base")), "left")
    said = F.col("_said")
    for name, value in constants.items():
        said = F.when(F.col("_src") == name, F.lit(value).cast("string")).otherwise(said)
    known = F.col("_src").isin(*tables, *constants)
    return out.withColumn("found", said).withColumn("known", known).drop("_src", "_from", "_base", "_said")


def first_match(df: DataFrame, side: DataFrame, keys: list[str], order: str, slack: float) -> DataFrame:
    """JN4: the first side row (start_s, end_s) by key; status mapped, missing, or failed where the end lies beyond duration plus slack."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = side.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    j = df.join(first, keys, "left")
    ok = F.col("_e") <= F.col("duration") + slack
    status = F.when(F.col("_e").isNull(), "missing").when(ok, "mapped").otherwise("failed")
    return j.withColumn("status", status).withColumn("start_s", F.when(ok, F.col("_s"))).withColumn("end_s", F.when(ok, F.col("_e"))).drop("_s", "_e")


def qa_verdict(jobs: DataFrame, covered: DataFrame, flagged: DataFrame) -> DataFrame:
    """JN6: every job gets a verdict: generation_error, missing_qa_report, qa_flagged or pass."""
    c = covered.select("job_id").distinct().withColumn("_c", F.lit(True))
    f = flagged.select("job_id").distinct().withColumn("_f", F.lit(True))
    v = F.when(F.col("status") == "error", "generation_error").when(F.col("_c").isNull(), "missing_qa_report").when(F.col("_f"), "qa_flagged").otherwise("pass")
    return jobs.join(c, "job_id", "left").join(f, "job_id", "left").withColumn("verdict", v).drop("_c", "_f")


def gate(df: DataFrame, reports: DataFrame, flagged: DataFrame, decodes: DataFrame, wake: Column) -> DataFrame:
    """JN7: kind mix: its unit's report exists and its name is not flagged; kind free: a decode exists and lacks the wake word. Missing is a fail."""
    out = (
        df.join(reports.select("unit").distinct().withColumn("_r", F.lit(True)), "unit", "left")
        .join(flagged.select("name").distinct().withColumn("_f", F.lit(True)), "name", "left")
        .join(decodes.select("name", "decode"), "name", "left")
    )
    ok = F.when(F.col("kind") == "mix", F.col("_r").isNotNull() & F.col("_f").isNull()).otherwise(F.col("decode").isNotNull() & ~wake)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False))).drop("_r", "_f", "decode")


def seen_elsewhere(df: DataFrame, sets: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """JN8: sets: (reason, column, keys of that column), in order; reason of the first hit, null for rows to keep."""
    out, reason = df, F.lit(None).cast("string")
    for n, (_, column, keys) in enumerate(sets):
        out = out.join(keys.select(column).distinct().withColumn(f"_h{n}", F.lit(True)), column, "left")
    for n in reversed(range(len(sets))):
        reason = F.when(F.col(f"_h{n}"), F.lit(sets[n][0])).otherwise(reason)
    return out.withColumn("reason", reason).drop(*[f"_h{n}" for n in range(len(sets))])


def decontaminate(df: DataFrame, eval_hashes: DataFrame) -> DataFrame:
    """JN9: without rows whose hash is in the eval set and rows derived from those (parent stem)."""
    bad = df.join(eval_hashes.select("hash").distinct(), "hash", "left_semi").select("stem").distinct()
    keep = df.join(bad, "stem", "left_anti")
    return keep.join(bad.withColumnRenamed("stem", "parent"), "parent", "left_anti")


def rename_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN10: (hash, old, new) for hashes that are unique on both sides; duplicate hashes come back with nulls and dup true."""
    a = old.groupBy("hash").agg(F.min("name").alias("old"), F.count(F.lit(1)).alias("_a"))
    b = new.groupBy("hash").agg(F.min("name").alias("new"), F.count(F.lit(1)).alias("_b"))
    dup = (F.col("_a") > 1) | (F.col("_b") > 1)
    return a.join(b, "hash").select("hash", F.when(~dup, F.col("old")).alias("old"), F.when(~dup, F.col("new")).alias("new"), dup.alias("dup"))


def dictionary_match(df: DataFrame, phrases: DataFrame) -> DataFrame:
    """JN11: phrases (text, intent, value); of several entries of a text, the one of the row's label, else the smallest intent."""
    p = phrases.groupBy("text").agg(F.array_sort(F.collect_set(F.struct("intent", "value"))).alias("_e"))
    e = F.col("_e")
    own = F.filter(e, lambda x: x["intent"] == F.col("label"))
    best = F.when(F.size(own) > 0, F.get(own, F.lit(0))).otherwise(F.get(e, F.lit(0)))
    return df.join(p, "text", "left").select(*df.columns, best["intent"].alias("intent"), best["value"].alias("value"))


def prefix_join(df: DataFrame, prefixes: DataFrame, most_words: int) -> DataFrame:
    """JN12: rows times the whole-word prefixes (prefix) that their text starts with, a space following; texts give their own prefixes, so the join is on equality."""
    w = F.split("text", " ")
    upto = F.least(F.size(w) - 1, F.lit(most_words))
    own = df.where(F.size(w) > 1).withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), upto), lambda n: F.array_join(F.slice(w, F.lit(1), n), " "))))
    return own.join(prefixes.select("prefix").distinct(), "prefix")


def plan_product(a: DataFrame, b: DataFrame, name: Column) -> DataFrame:
    """JN13: every pair of two dimension tables with a target name; names that occur twice are marked."""
    pairs = a.crossJoin(b).withColumn("name", name)
    n = pairs.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("clash"))
    return pairs.join(n, "name")


#: Parts of the time from the first range to the last.
PARTS = 4096


def assign_interval(events: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, payload: list[str]) -> DataFrame:
    """JN15: each event gets the last range of its key with start <= at, if at < end, with the time since start.

    Union and window, no range join. Time is cut into equal parts; the last range of a key's part is carried to its later ones, and only the rows of one part are sorted together, so a key of any size is many tasks.
    """
    first, last = ranges.agg(F.min(start), F.max(start)).first()
    width = (last - first) / PARTS if first is not None and last > first else 1
    part = F.floor((F.greatest(F.least(F.col("_t"), F.lit(last)), F.lit(first)) - F.lit(first)) / F.lit(width)) if first is not None else F.lit(0)
    r = ranges.select(key, F.col(start).alias("_t"), F.lit(0).alias("_o"), F.struct(F.col(start).alias("_s"), F.col(end).alias("_e"), *payload).alias("_r"))
    e = events.withColumn("_t", F.col(at)).withColumn("_o", F.lit(1))
    both = e.unionByName(r, allowMissingColumns=True).withColumn("_place", F.struct(key, part.alias("part")))
    per = both.groupBy("_place").agg(F.max_by("_r", F.when(F.col("_o") == 0, F.col("_t"))).alias("_r"))
    earlier = Window.partitionBy(F.col(f"_place.{key}")).orderBy("_place.part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    carried = per.select("_place", F.last("_r", ignorenulls=True).over(earlier).alias("_carried"))
    w = Window.partitionBy("_place").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    x = both.join(carried, "_place").withColumn("_last", F.coalesce(F.last("_r", ignorenulls=True).over(w), F.col("_carried"))).where("_o = 1")
    return x.where(F.col(at) < F.col("_last._e")).withColumn("since", F.col(at) - F.col("_last._s")).select(*events.columns, "since", *[F.col(f"_last.{p}").alias(p) for p in payload])


def aligned(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JN16: rows of two runs side by side, with `same` over the fields, nulls equal."""
    right = b.select(key, *[F.col(f).alias(f"{f}_b") for f in fields])
    same = reduce(lambda x, y: x & y, [F.col(f).eqNullSafe(F.col(f"{f}_b")) for f in fields])
    return a.select(key, *fields).join(right, key).withColumn("same", same)


def set_algebra(a: DataFrame, b: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """JN17: counts of keys removed (only in a), added (only in b), both and neither."""
    ka = a.select(key).distinct().withColumn("_a", F.lit(True))
    kb = b.select(key).distinct().withColumn("_b", F.lit(True))
    j = universe.select(key).distinct().join(ka, key, "left").join(kb, key, "left")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return j.agg(F.count_if(in_a & ~in_b).alias("removed"), F.count_if(~in_a & in_b).alias("added"), F.count_if(in_a & in_b).alias("both"), F.count_if(~in_a & ~in_b).alias("neither"))
