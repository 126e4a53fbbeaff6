"""Ranks and running totals within strata of any size.

A stratum may hold a third of all rows, so no window runs over a stratum.
Rows fall into slots that rise with the order (the first digits of a digest,
or equal parts of a number's span); slots are counted with map-side sums, the
counts give each slot's offset, and only a slot's own rows are sorted
together. Slots that cannot be needed are dropped before that sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeding import number
from ..sources.kept import keep

#: Slots of a stratum.
SLOTS = 1 << 16


def digest_slot(digest: Column) -> Column:
    """Slot of a hex digest: its first 16 bits."""
    return F.floor(number(digest) / SLOTS)


def with_span_slot(df: DataFrame, by: list[str], value: str, slot: str = "_slot") -> DataFrame:
    """df with a slot of each row: which of equal parts of its stratum's span the number lies in; infinite values have slots of their own."""
    v = F.col(value).cast("double")
    finite = F.when(F.abs(v) < float("inf"), v)
    span = df.groupBy(*by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    x = df.crossJoin(span) if not by else df.join(span.select(F.struct(*by).alias("_in"), "_lo", "_hi"), F.struct(*by) == F.col("_in"), "left").drop("_in")
    part = F.coalesce(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (SLOTS - 1)), F.lit(0))
    place = F.when(v == float("inf"), SLOTS).when(v == float("-inf"), -1).when(F.col("_hi") > F.col("_lo"), part).otherwise(0)
    return x.withColumn(slot, place.cast("long")).drop("_lo", "_hi")


def running(df: DataFrame, by: list[str], order: list[Column], slot: str, sums: dict[str, Column], upto: dict[str, Column] | None = None, descending: bool = False) -> DataFrame:
    """df with, for each name in sums, the total over the rows of the stratum that come before in order. upto: slots whose total before reaches the bound (a column of `by`) are left out."""
    way = F.desc(slot) if descending else F.asc(slot)
    per = df.groupBy(*by, slot).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    first = per.select(F.struct(*by, slot).alias("_place"), *by, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    for n, bound in (upto or {}).items():
        first = first.where(F.col(f"_{n}") < bound)
    x = df.withColumn("_place", F.struct(*by, slot)).join(first.select("_place", *[f"_{n}" for n in sums]), "_place")
    inside = Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("_place", *[f"_{n}" for n in sums])


def ranked(df: DataFrame, by: list[str], digest: Column, out: str = "_r", upto: Column | None = None) -> DataFrame:
    """df with the row's rank from 0 within its stratum, in order of a hex digest. upto: only rows of slots that begin below it are kept."""
    x = df.withColumn("_digest", digest).withColumn("_slot", digest_slot(F.col("_digest")))
    return running(x, by, [F.col("_digest")], "_slot", {out: F.lit(1)}, {out: upto} if upto is not None else None).drop("_digest", "_slot")


def ranked_by_number(df: DataFrame, by: list[str], value: str, out: str = "_r") -> DataFrame:
    """df with the row's rank from 0 within its stratum, in order of a number."""
    return running(with_span_slot(df, by, value), by, [F.col(value)], "_slot", {out: F.lit(1)}).drop("_slot")


#: Values that one task sorts; above it a wanted slot is divided again.
FEW = 100_000


def at_ranks(df: DataFrame, by: str, value: str, want: DataFrame, few: int = FEW) -> DataFrame:
    """by, rank, value, before: the value at each wanted rank (want: by, rank; ranks from 0 in rising order) and the number of smaller ones.

    Selection in rounds: distinct values are counted by equal parts of their span, the counts tell which part holds a rank, and only that part goes on, divided anew, until no part has more than `few` values. Equal ranks of parts meet; nothing runs over a stratum.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each rank and value that may hold it; _b: rows before the part
    x = per.join(want.select(F.struct(by).alias("_in"), "rank"), F.struct(by) == F.col("_in")).drop("_in").withColumn("_b", F.lit(0).cast("long"))
    left = None
    for _ in range(64):
        x = keep(_narrowed(x, by, value), "ranks")
        most = x.groupBy(F.struct(by, "rank").alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("d")).agg(F.max(F.when(F.col("d") > 1, F.col("n")))).first()[0] or 0
        if most <= few or most == left:
            break
        left = most
    w = Window.partitionBy(F.struct(by, "rank")).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_c", F.col("_b") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return x.where((F.col("_c") <= F.col("rank")) & (F.col("rank") < F.col("_c") + F.col("_n"))).select(by, "rank", value, F.col("_c").alias("before"))


def _narrowed(x: DataFrame, by: str, value: str) -> DataFrame:
    """Of each wanted rank the part of its values that holds it."""
    s = with_span_slot(x, [by, "rank"], value)
    place = F.struct(by, "rank", "_slot")
    slots = s.groupBy(by, "rank", "_b", "_slot").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(F.struct(by, "rank")).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = slots.withColumn("_first", F.col("_b") + F.coalesce(F.sum("_m").over(before), F.lit(0)))
    held = first.where((F.col("_first") <= F.col("rank")) & (F.col("rank") < F.col("_first") + F.col("_m"))).select(place.alias("_place"), "_first")
    return s.join(held, place == F.col("_place")).select(by, "rank", value, "_n", F.col("_first").alias("_b"))
