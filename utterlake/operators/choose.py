"""Operating points, top-k and first events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import exhaustive
from .ranks import running, with_span_slot


def best_threshold(sweep: DataFrame) -> DataFrame:
    """TK1: the row of the sweep with the largest J, ties to the highest threshold."""
    return sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct("j", "threshold")).alias("r")).select("r.*")


def choose_margin(grid: DataFrame, budget: float) -> DataFrame:
    """TK2: grid: margin, accuracy, far. Margins whose accuracy falls at most `budget` below that of the smallest margin; of these the lowest far, ties to the smallest margin."""
    base = grid.agg(F.min_by("accuracy", "margin").alias("base"))
    fit = grid.crossJoin(base).where(F.col("accuracy") >= F.col("base") - budget)
    return fit.agg(F.min(F.struct("far", "margin", "accuracy")).alias("r")).select("r.margin", "r.far", "r.accuracy")


def iso_threshold(df: DataFrame, by: str, score: str, want: DataFrame, rows: Column | None = None) -> DataFrame:
    """TK3: want: by, n. The n-th largest score of each key; +infinity for n <= 0, -infinity when there are fewer. Ranks run over distinct scores. rows: how many rows a row stands for."""
    per = df.where(F.col(score).isNotNull()).groupBy(by, score).agg(F.sum(rows if rows is not None else F.lit(1)).alias("_n"))
    x = running(with_span_slot(per, [by], score), [by], [F.desc(score)], "_slot", {"_before": F.col("_n")}, descending=True)
    j = want.join(x, by, "left").groupBy(by, "n").agg(F.max(F.when(F.col("_before") + F.col("_n") >= F.col("n"), F.col(score))).alias("t"))
    inf = F.lit(float("inf"))
    return j.select(by, F.when(F.col("n") <= 0, inf).otherwise(F.coalesce(F.col("t").cast("double"), -inf)).alias("tau"))


def budget_threshold(df: DataFrame, score: str, rate: float) -> DataFrame:
    """TK4: `strict`: rows must score above it so that at most floor(rate * n + 1e-9) of df do; 0 when there are no more rows than that."""
    n = df.agg(F.floor(F.count(F.lit(1)) * rate + 1e-9).alias("allowed"))
    above = exhaustive(df, score, F.lit(False))
    return above.crossJoin(n).agg(F.coalesce(F.max(F.when(F.col("false_accepts") > F.col("allowed"), F.col(score))), F.lit(0.0)).alias("strict"))


def relax(per_intent: DataFrame, overall: Column) -> DataFrame:
    """TK5: own thresholds, never above the common one."""
    return per_intent.withColumn("tau", F.least("tau", overall))


def choose_config(grid: DataFrame, score: str, order: list[str]) -> DataFrame:
    """TK6: the config of the lowest score, ties in a fixed order."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("config"))
    return grid.agg(F.min_by("config", F.struct(score, place.alias("p"))).alias("config"), F.min(score).alias(score))


def mode_vote(obs: DataFrame, period: list[str], order: str, cls: list[str], confidence: str) -> DataFrame:
    """TK7: the most frequent class of a period; ties by summed confidence, then the one seen first; with its latest place and mean confidence."""
    g = obs.groupBy(*period, *cls).agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum(confidence), 9).alias("_s"), F.min(order).alias("_f"), F.max(order).alias("latest"), F.avg(confidence).alias("mean"))
    best = F.max_by(F.struct(*cls, "votes", "latest", "mean"), F.struct("votes", "_s", (-F.col("_f")).alias("f")))
    return g.groupBy(*period).agg(best.alias("r")).select(*period, *[F.col(f"r.{c}").alias(c) for c in (*cls, "votes", "latest", "mean")])


def review_sample(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """TK8: the first n rows of each bucket."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def first_event(df: DataFrame, session: str, at: str, fields: list[str]) -> DataFrame:
    """TK9: the first event of each session."""
    return df.groupBy(session).agg(F.min(F.struct(at, *fields)).alias("r")).select(session, f"r.{at}", *[f"r.{f}" for f in fields])


def loosest(df: DataFrame, score: str, target: Column, condition: str, budget: int) -> DataFrame:
    """TK10: the smallest target score above the (budget + 1)-th highest other score of every condition."""
    other = df.where(~target)
    want = other.groupBy(condition).agg(F.lit(budget + 1).alias("n"))
    edge = iso_threshold(other, condition, score, want).agg(F.max("tau").alias("edge"))
    return df.where(target).crossJoin(edge).where(F.col("edge").isNull() | (F.col(score) > F.col("edge"))).agg(F.min(score).alias("tau"))
