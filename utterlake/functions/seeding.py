"""Draws that are pure functions of seed, purpose and key, so that no result depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, purpose: str, *keys: Column) -> Column:
    """Hex digest to order by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys]))


def number(h: Column) -> Column:
    """First 32 bits of a digest, as a long."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, purpose: str, *keys: Column) -> Column:
    """Uniform in [0, 1)."""
    return number(draw(seed, purpose, *keys)) / F.lit(4294967296.0)


def permuted(k: Column, size: Column, seed: int | str, purpose: str, *keys: Column) -> Column:
    """Where a seeded permutation of 0 .. size - 1 takes k: a four-round Feistel network over the smallest a x b numbers with a about the root of size, walked on until it is back below size. Another permutation for each value of keys."""
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    b = F.ceil(size / a).cast("long")

    def once(x: Column) -> Column:
        halves = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))

        def turn(s: Column, i: Column) -> Column:
            mixed = lambda half: number(draw(seed, purpose, *keys, i, half))
            left = F.struct(F.pmod(s["l"] + mixed(s["r"]), a).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + mixed(s["l"]), b).alias("r"))
            return F.when(i % 2 == 0, left).otherwise(right)

        done = F.aggregate(F.sequence(F.lit(0), F.lit(3)), halves, turn)
        return done["l"] * b + done["r"]

    over = a * b - size  # at most so many numbers to walk over
    walks = F.when(over > 0, F.sequence(F.lit(1).cast("long"), over)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(walks, once(k.cast("long")), lambda x, _: F.when(x < size, x).otherwise(once(x)))
