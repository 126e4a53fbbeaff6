"""Plug points: rules given as functions from columns to columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(df: DataFrame, predict: Callable[[], Column], accept: Callable[[Column], Column]) -> DataFrame:
    """UD1: predicted and accepted columns from a scorer and a policy."""
    return df.withColumn("predicted", predict()).withColumn("accepted", F.coalesce(accept(F.col("predicted")), F.lit(False)))


def fold(df: DataFrame, key: str, order: list[str], zero: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """UD2: an ordered fold of each key's rows (as structs of the order columns); bounded by the rows of one key."""
    return df.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(F.struct(*order))), zero, step).alias("state"))


def saved_threshold(report: DataFrame, metric: str, fallback: float) -> DataFrame:
    """UD3: threshold of a saved report, the fallback without one, and whether it was found."""
    row = report.where(F.col("metric") == metric).agg(F.max("value").alias("v"))
    return row.select(F.coalesce(F.col("v").cast("double"), F.lit(fallback)).alias("threshold"), F.col("v").isNotNull().alias("found"))


def transforms(d: DataFrame, mass: str, frames: str, length: str, gap: str) -> DataFrame:
    """AR8: score transforms, null-safe: mass per frame, mass per symbol, command less competitor, greedy less frame gap."""
    m = F.col(mass)
    return d.withColumns({"per_frame": F.try_divide(m, F.col(frames)), "per_symbol": F.try_divide(m, F.col(length)), "lead": m - F.coalesce(F.col(gap), F.lit(0.0)), "greedy_gap": F.abs(m) - F.abs(F.col(gap))})


def target_label(df: DataFrame, phrases: DataFrame, intents: list[str]) -> DataFrame:
    """ST11: df: text, label, bucket, slot_value. Target intent and slot with the reason: nontarget, intent_unmapped, phrase, phrase_label_mismatch, manifest_slot_value, nonslotted or no_slot_target."""
    p = phrases.groupBy("text").agg(F.min("intent").alias("_i"), F.min("value").alias("_v"), F.max(F.when(F.col("slot").isNotNull(), True).otherwise(False)).alias("_s"))
    slotted = phrases.where(F.col("slot").isNotNull()).select(F.col("intent").alias("label"), F.lit(True).alias("_slotted")).distinct()
    x = df.join(p, "text", "left").join(slotted, "label", "left")
    why = (
        F.when(F.col("bucket") != "target_commands", "nontarget")
        .when(~F.col("label").isin(intents), "intent_unmapped")
        .when(F.col("_slotted").isNull(), "nonslotted")
        .when(F.col("_i").isNotNull() & (F.col("_i") != F.col("label")), "phrase_label_mismatch")
        .when(F.col("_v").isNotNull(), "phrase")
        .when(F.col("slot_value").isNotNull(), "manifest_slot_value")
        .otherwise("no_slot_target")
    )
    slot = F.when(why == "phrase", F.col("_v")).when(why == "manifest_slot_value", F.col("slot_value"))
    return x.withColumn("reason", why).withColumn("slot", slot).drop("_i", "_v", "_s", "_slotted")


def slot_truth(own: Column, looked_up: Column) -> tuple[Column, Column]:
    """ST14: a row's own slot value or the dictionary's; unparseable when there is text but no leading number or known word."""
    value = F.coalesce(F.nullif(F.trim(own), F.lit("")), looked_up)
    return value, value.isNotNull() & ~value.rlike("^([0-9]+|on|off)", )
