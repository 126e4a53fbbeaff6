"""Collation, set operations and validation. Guards return violations as rows; `must_be_empty` turns them into errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import adjacent_repeats, encodable


class Violation(ValueError):
    """A guard found rows that break its rule."""


def must_be_empty(violations: DataFrame, rule: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise Violation(f"{rule}: {[r.asDict() for r in rows]}")


def widened_union(frames: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """SO1: union by name, missing columns null, in a declared order."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*columns) if columns else out


def symmetric_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """SO2, CV14: rows in one side only, with multiplicity, and the side."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """SO3: sizes of the distinct difference and intersection, both ways, in one pass."""
    both = a.withColumn("_in", F.lit(1)).unionByName(b.withColumn("_in", F.lit(2)))
    per = both.groupBy(*a.columns).agg(F.bit_or("_in").alias("_in"))
    return per.agg(*[F.count_if(F.col("_in") == i).alias(n) for i, n in ((1, "only_a"), (2, "only_b"), (3, "both"))])


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """SO4: order-free fingerprint of rows: count, and sums of parts of each row's digest."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n"), part(1).alias("f1"), part(9).alias("f2"))


def collate(base: DataFrame, new: DataFrame, path: str, rebased: Column) -> DataFrame:
    """CV1: base rows with the path rebased, then the new rows."""
    return base.withColumn(path, rebased).unionByName(new, allowMissingColumns=True)


def expand(df: DataFrame, noisy: Column, name: str, source: str) -> DataFrame:
    """CV2: each row clean, and once more as a noisy sibling (name and source suffixed) where wanted."""
    copies = F.when(noisy, F.array(F.lit(""), F.lit("_noisy"))).otherwise(F.array(F.lit("")))
    return df.withColumn("_x", F.explode(copies)).withColumn(name, F.concat(name, "_x")).withColumn(source, F.concat(source, "_x")).withColumn("is_noisy", F.col("_x") != "").drop("_x")


def control_pair(df: DataFrame, treated: Column, split: str) -> tuple[DataFrame, DataFrame]:
    """CV3: treatment is everything, control leaves out treated training rows; validation and test rows are the same."""
    return df, df.where(~(treated & (F.col(split) == "train")))


def held_out_difference(a: DataFrame, b: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """CV3, CV4: rows outside train that one side lacks."""
    keep = F.col(split) != "train"
    return symmetric_difference(a.where(keep), b.where(keep), columns)


def train_only(added: DataFrame, split: str) -> DataFrame:
    """CV4: added rows that are not train."""
    return added.where(~F.col(split).eqNullSafe(F.lit("train")))


def group_leaks(df: DataFrame, family: str, group: str, split: str) -> DataFrame:
    """CV5: groups of a family in more than one split; blank and ref_ groups are exempt."""
    return df.where(F.col(group).isNotNull() & ~F.col(group).startswith("ref_")).groupBy(family, group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def share_check(df: DataFrame, split: str, what: Column, share: float, tolerance: float) -> DataFrame:
    """CV6: share of rows with a property in each split, ok within the tolerance."""
    s = F.avg(F.coalesce(what, F.lit(False)).cast("int"))
    return df.groupBy(split).agg(s.alias("share")).withColumn("ok", F.abs(F.col("share") - share) <= tolerance)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """CV7: keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def absent(df: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """CV8: rows whose file is not in the listing."""
    return df.join(listing.select(path).distinct(), path, "left_anti")


def unencodable(df: DataFrame, text: Column) -> DataFrame:
    """CV9: rows with a symbol outside the alphabet."""
    return df.where(~encodable(text))


def length_feasible(text: Column, duration: Column) -> Column:
    """CV10: 10 ms frames hold every symbol, and one more for each repeat."""
    frames = F.floor(duration * 16000 / 160) + 1
    return frames >= F.length(text) + adjacent_repeats(text)


def format_breaks(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    """CV11: rows where a column differs from its constant."""
    bad = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in constants.items()])
    return df.where(bad)


def consolidate(subsets: dict[str, DataFrame | None], path: str, spark) -> tuple[DataFrame, DataFrame]:
    """CV12: subsets under a subset column with prefixed paths, and a count of each known subset, 0 for absent ones."""
    parts = [df.withColumn(path, F.concat(F.lit(n + "/"), path)).withColumn("subset", F.lit(n)) for n, df in subsets.items() if df is not None]
    out = widened_union(parts)
    known = spark.createDataFrame([(n,) for n in subsets], "subset string")
    counts = out.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))
    return out, known.join(counts, "subset", "left").select("subset", F.coalesce("n", F.lit(0)).alias("n"))


def licence_cover(files: DataFrame, waivers: DataFrame, rank: list[str]) -> DataFrame:
    """CV13: each file with its number of waivers and the most restrictive licence among them; 0 waivers: uncovered."""
    order = F.array(*[F.lit(x) for x in rank])
    w = waivers.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_position(order, F.col("licence"))).alias("r"))
    return files.select("file").distinct().join(w, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("waivers"), F.get(order, F.col("r").cast("int") - 1).alias("licence"))


def phase_guard(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """CV15: distinct values of the guarded columns that differ from what the phase expects."""
    rows = [df.select(F.lit(c).alias("field"), F.col(c).cast("string").alias("found")).distinct().where(~F.col("found").eqNullSafe(F.lit(v))) for c, v in expected.items()]
    return reduce(DataFrame.unionByName, rows)


def expected_check(got: DataFrame, expected: DataFrame) -> DataFrame:
    """CV16: got: metric, value; expected: metric, value (exact), lo, hi (band). PASS, FAIL, WITHIN, OUTSIDE or MISSING, with delta."""
    j = expected.withColumnRenamed("value", "want").join(got, "metric", "left")
    exact = F.col("want").isNotNull()
    status = F.when(F.col("value").isNull(), "MISSING").when(exact, F.when(F.col("value") == F.col("want"), "PASS").otherwise("FAIL")).otherwise(F.when(F.col("value").between(F.col("lo"), F.col("hi")), "WITHIN").otherwise("OUTSIDE"))
    return j.select("metric", status.alias("status"), F.when(exact, F.col("value") - F.col("want")).alias("delta"))


def rescued(flagged: DataFrame, heard: Column, expected: Column) -> DataFrame:
    """CV17: flagged rows whose transcript is the expected text after normalisation."""
    return flagged.where(heard == expected)


def eval_manifest(df: DataFrame, noise: DataFrame, splits: list[str], match: str) -> DataFrame:
    """CV18: kept splits, target rows with an exact variation only, and the noise rows."""
    keep = F.col("split").isin(splits) & ((F.col("bucket") != "target_commands") | F.col(match).startswith("exact"))
    return df.where(keep).unionByName(noise, allowMissingColumns=True)


def recomputed(saved: DataFrame, fresh: DataFrame, key: str, rates: list[str], counts: list[str], eps: float = 1e-12) -> DataFrame:
    """CV19: keys where saved rates differ from recomputed ones by more than eps, or counts at all."""
    cols = rates + counts
    j = saved.join(fresh.select(key, *[F.col(c).alias(f"{c}_f") for c in cols]), key, "left")
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c) - F.col(f"{c}_f")) > (eps if c in rates else 0), F.lit(True)) for c in cols])
    return j.where(bad).select(key)


def supplement(df: DataFrame, voice_split: str, kind: Column, split: Column) -> tuple[DataFrame, DataFrame]:
    """CV20: rows of training voices that convert to something, with their split; and counts of skip reasons."""
    reason = F.when(F.col(voice_split) != "train", "voice_split").when(kind == "dropped", "no_variation")
    x = df.withColumn("reason", reason).withColumn("split", split)
    return x.where("reason IS NULL").drop("reason"), x.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def probe_sets(raw: DataFrame, passed: DataFrame, noise: DataFrame, slots: Column) -> DataFrame:
    """CV21: raw and QA-passed clips as two test-only sets that share one noise pool; slot parsed from JSON."""
    one = lambda df, name: df.unionByName(noise, allowMissingColumns=True).withColumn("probe", F.lit(name)).withColumn("split", F.lit("test"))
    return one(raw, "raw").unionByName(one(passed, "derived"), allowMissingColumns=True).withColumn("slot", slots)


def candidate_pool(a: DataFrame, b: DataFrame, ok: DataFrame, rescue: DataFrame, key: str, variation: str) -> DataFrame:
    """CV22: rows of two sources that passed QA or were rescued, with the source, by variation."""
    good = ok.select(key).unionByName(rescue.select(key)).distinct()
    union = a.withColumn("origin", F.lit("a")).unionByName(b.withColumn("origin", F.lit("b")))
    return union.join(good, key, "left_semi").groupBy(variation, "origin").agg(F.count(F.lit(1)).alias("n"))
