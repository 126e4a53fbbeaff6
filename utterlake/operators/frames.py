"""Frame-table operators: runs, streaks, quiet windows, cut points, segments. One partition a recording or session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_section(lines: DataFrame, file: str, pos: str, heading: Column) -> DataFrame:
    """WN1: the last heading at or above each line."""
    w = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def collapse(frames: DataFrame, utt: str, frame: str, token: str, logp: str, blank: int) -> DataFrame:
    """WN2: frames (one row a frame and token) to the best token of each frame, repeats dropped, then blanks; with the mean best log-probability."""
    best = frames.groupBy(utt, frame).agg(F.max(F.struct(logp, (-F.col(token)).alias("t"))).alias("b")).select(utt, frame, (-F.col("b.t")).alias("t"), F.col(f"b.{logp}").alias("lp"))
    run = best.withColumn("p", F.lag("t").over(Window.partitionBy(utt).orderBy(frame)))
    kept = F.when(~F.col("t").eqNullSafe(F.col("p")) & (F.col("t") != blank), F.struct(frame, "t"))
    return run.groupBy(utt).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), " ").alias("tokens"), F.avg("lp").alias("mean_logp"))


def trailing_hold(frames: DataFrame, utt: str, frame: str, quiet: Column, hold: int) -> DataFrame:
    """WN3: whether the last `hold` frames are all quiet; false with fewer frames."""
    r = F.row_number().over(Window.partitionBy(utt).orderBy(F.desc(frame)))
    last = frames.withColumn("_r", r).where(F.col("_r") <= hold)
    return last.groupBy(utt).agg((F.bool_and(F.coalesce(quiet, F.lit(False))) & (F.count(F.lit(1)) == hold)).alias("ended"))


def active_seconds(frames: DataFrame, utt: str, active: Column, frame_s: float) -> DataFrame:
    """WN4: seconds of active frames."""
    return frames.groupBy(utt).agg((F.count_if(active) * frame_s).alias("active_s"))


def inner_means(frames: DataFrame, utt: str, frame: str, blank: Column, value: str) -> DataFrame:
    """WN5: mean of a value between the first and the last frame that is not blank."""
    w = Window.partitionBy(utt)
    edge = F.when(~blank, F.col(frame))
    x = frames.withColumn("_a", F.min(edge).over(w)).withColumn("_b", F.max(edge).over(w))
    return x.where(F.col(frame).between(F.col("_a"), F.col("_b"))).groupBy(utt).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def streaks(rows: DataFrame, session: str, order: str, same: list[str], ok: Column) -> DataFrame:
    """WN6: length of the streak of equal accepted observations that ends at each row; 0 when rejected."""
    w = Window.partitionBy(session).orderBy(order)
    prev_same = F.lit(True)
    for c in same:
        prev_same = prev_same & F.col(c).eqNullSafe(F.lag(c).over(w))
    x = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    x = x.withColumn("_new", (~(prev_same & F.coalesce(F.lag("_ok").over(w), F.lit(False)) & F.col("_ok"))).cast("int"))
    x = x.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("streak", F.when(F.col("_ok"), F.row_number().over(Window.partitionBy(session, "_isle").orderBy(order))).otherwise(0)).drop("_ok", "_new", "_isle")


def quietest(frames: DataFrame, rec: str, frame: str, energy: str, width: int, region: Column) -> DataFrame:
    """WN7: first frame of the full window of least energy in each region; region is null outside."""
    w = Window.partitionBy(rec, "_g").orderBy(frame).rowsBetween(0, width - 1)
    x = frames.withColumn("_g", region).where("_g IS NOT NULL")
    x = x.withColumn("_e", F.sum(energy).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == width)
    return x.groupBy(rec, F.col("_g").alias("region")).agg(F.min_by(frame, F.struct("_e", frame)).alias("at"), F.min("_e").alias("energy"))


def cut_point(frames: DataFrame, rec: str, frame: str, energy: str, lo: int, hi: int) -> DataFrame:
    """WN8: first frame of least energy between lo and hi."""
    return frames.where(F.col(frame).between(lo, hi)).groupBy(rec).agg(F.min_by(frame, F.struct(energy, frame)).alias("cut"))


def loudest_window(frames: DataFrame, rec: str, frame: str, energy: str, width: int) -> DataFrame:
    """WN9: first frame of the full window of most energy, the last start included; ties to the first."""
    w = Window.partitionBy(rec).orderBy(frame).rowsBetween(0, width - 1)
    x = frames.withColumn("_e", F.sum(energy).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == width)
    return x.groupBy(rec).agg(F.max_by(frame, F.struct("_e", (-F.col(frame)).alias("f"))).alias("at"))


def fixed_windows(df: DataFrame, length: str, width: int, stride: int) -> DataFrame:
    """WN10: window starts over a long recording, a last one flush right; none for recordings shorter than the width."""
    n = F.col(length)
    starts = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), n.cast("long") - width, F.lit(stride).cast("long")), F.array(n.cast("long") - width))))
    return df.where(n >= width).withColumn("start", F.explode(starts))


def crop_point(align: DataFrame, utt: str, frame: str, pos: str, prefix_len: str, grace: int, least: int) -> DataFrame:
    """WN11: align: frame and character position. Crop after the prefix's last character, at most at the next word's first; failures no_gap and crop_too_short."""
    last = F.max(F.when(F.col(pos) < F.col(prefix_len), F.col(frame)))
    nxt = F.min(F.when(F.col(pos) > F.col(prefix_len), F.col(frame)))
    g = align.groupBy(utt).agg(last.alias("last"), nxt.alias("next"))
    crop = F.least(F.col("last") + 1 + grace, F.col("next"))
    why = F.when(F.col("last").isNull() | F.col("next").isNull() | (F.col("next") <= F.col("last")), "no_gap").when(crop < least, "crop_too_short")
    return g.withColumn("why", why).withColumn("crop", F.when(why.isNull(), crop)).drop("last", "next")


def best_lag(a: DataFrame, b: DataFrame, seg: str, frame: str, value: str, radius: int, least: float) -> DataFrame:
    """WN12: the shift of b with the highest correlation to a in each segment (ties to the smallest shift), ok above `least`."""
    lags = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    moved = a.withColumn("lag", lags).withColumn("_f", F.col(frame) + F.col("lag"))
    j = moved.join(b.select(F.col(frame).alias("_f"), F.col(value).alias("_v")), "_f")
    c = j.groupBy(seg, "lag").agg(F.corr(value, "_v").alias("r")).where("r IS NOT NULL AND NOT isnan(r)").withColumn("r", F.round("r", 9))
    best = c.groupBy(seg).agg(F.max(F.struct("r", (-F.col("lag")).alias("m"))).alias("x"))
    return best.select(seg, (-F.col("x.m")).alias("lag"), F.col("x.r").alias("r"), (F.col("x.r") > least).alias("ok"))
