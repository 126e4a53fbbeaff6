"""Array arithmetic as column functions: argmax, top-k, softmax, levels, mixing, placement, sign test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(a: Column) -> Column:
    """AR1: index from 0, the first of equal maxima."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_k(a: Column, k: int) -> Column:
    """AR2: indices of the k largest, equal values by index."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    """AR3: shifted by the maximum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(F.transform(a, lambda y: F.exp(y - F.array_max(a)))))


def log_softmax(a: Column) -> Column:
    shift = F.array_max(a) + F.log(total(F.transform(a, lambda y: F.exp(y - F.array_max(a)))))
    return F.transform(a, lambda x: x - shift)


def power(a: Column) -> Column:
    """Mean square, 0 for an empty array."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a)).otherwise(0.0)


def looped(noise: Column, n: Column, start: Column) -> Column:
    """noise repeated or cut to n values from start."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(noise, F.pmod(i + start, F.size(noise))))).otherwise(F.slice(noise, 1, 0))


def snr_mix(speech: Column, noise: Column, snr_db: Column, start: Column) -> Column:
    """AR4: speech plus noise at a signal-to-noise ratio; speech unchanged if either power is 0."""
    fitted = looped(noise, F.size(speech), start)
    scale = F.sqrt(power(speech) / (power(fitted) * F.pow(F.lit(10.0), snr_db / 10)))
    ok = (power(speech) > 0) & (power(fitted) > 0)
    return F.when(ok, F.zip_with(speech, fitted, lambda s, x: s + scale * x)).otherwise(speech)


def rms(a: Column) -> Column:
    return F.sqrt(power(a))


def peak(a: Column) -> Column:
    """AR5: largest absolute value."""
    return F.coalesce(F.array_max(F.transform(a, lambda x: F.abs(x))), F.lit(0.0))


def clipped(a: Column) -> Column:
    return peak(a) >= 0.999


def rounded(x: Column, digits: int) -> Column:
    """x rounded, halves away from zero; what rounds to zero keeps its sign, as in SQL engines that round doubles, where Spark's decimals lose it."""
    return F.signum(x) * F.abs(F.round(x, digits))


def placed(a: Column, n: int, where: str) -> Column:
    """AR6: a in n values, zero-filled; left, right or centre; longer arrays are cut about the centre."""
    over = F.size(a) - n
    cut = F.slice(a, F.floor(F.greatest(over, F.lit(0)) / 2).cast("int") + 1, F.lit(n))
    free = F.lit(n) - F.size(cut)
    before = {"left": F.lit(0), "right": free, "centre": F.floor(free / 2).cast("int")}[where]
    return F.concat(F.array_repeat(F.lit(0.0), before), cut, F.array_repeat(F.lit(0.0), free - before))


def sign_test(k: Column, n: Column) -> Column:
    """AR7: P(X >= k) for n fair coins; 1 when n is 0. By recurrence from 0 up to 1000 coins; 0.5 to the n underflows soon after, so beyond, the term at the nearer tail's edge comes from Stirling's series and the recurrence runs on from there until nothing is left."""
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"]
        return F.struct((term * (n - i) / (i + 1)).alias("term"), F.when(i >= k, acc["sum"] + term).otherwise(acc["sum"]).alias("sum"))

    few = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(1000)).cast("long")), start, step)["sum"]

    upper = 2 * k > n
    edge = F.when(upper, k).otherwise(n - k + 1).cast("long")  # P(X >= k) = 1 - P(X >= n - k + 1)
    rest = (n - edge).cast("double")
    lean = (2 * edge - n) / n
    series = lambda x: 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    log_term = series(n.cast("double")) - series(edge.cast("double")) - series(rest) + F.log(n / (2 * F.lit(math.pi) * edge * rest)) / 2 - edge * F.log1p(lean) - rest * F.log1p(-lean)
    first = F.when(edge > n, 0.0).when(edge == n, F.pow(F.lit(0.5), n)).otherwise(F.exp(log_term))
    last = F.greatest(F.least(n, edge + F.ceil(10 * F.sqrt(n)) + 50), edge).cast("long")
    begin = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(edge, last), begin, lambda acc, i: F.struct((acc["term"] * (n - i) / (i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")))["sum"]
    return F.when(n == 0, 1.0).when(n <= 1000, few).otherwise(F.when(upper, tail).otherwise(1 - tail))


def zscore(a: Column) -> Column:
    """AR9: (x - mean) / (sample deviation + 1e-5)."""
    mean = total(a) / F.size(a)
    sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.greatest(F.size(a) - 1, F.lit(1)))
    return F.transform(a, lambda x: (x - mean) / (sd + 1e-5))
