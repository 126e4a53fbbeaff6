"""Acceptance, rates and intervals as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accepted(intent: Column, confidence: Column, threshold: Column | float) -> Column:
    """PF14: an intent whose confidence reaches the threshold; null confidence never does."""
    return F.coalesce(intent.isNotNull() & (confidence >= threshold), F.lit(False))


def margin_ok(gap: Column, margin: Column | float | None) -> Column:
    """PF15: no competitor, or a gap of at least the margin; no margin is always met."""
    if margin is None:
        return F.lit(True)
    return gap.isNull() | (gap >= margin)


def ratio(part: Column, whole: Column) -> Column:
    """Null on an empty denominator."""
    return F.try_divide(part.cast("double"), whole)


def ratio0(part: Column, whole: Column) -> Column:
    """0 on an empty denominator."""
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def count_where(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def wilson(k: Column, n: Column, upper: bool, z: float = 1.96) -> Column:
    """AG12: bound of the Wilson interval, within 0 and 1; null when n is 0."""
    p, nn = k / n, n.cast("double")
    mid = p + z * z / (2 * nn)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * nn)) / nn)
    bound = (mid + half if upper else mid - half) / (1 + z * z / nn)
    return F.when(n > 0, F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0)))
