"""Sharding: a two-pass external shuffle.

Pass one scatters whole records into memory-sized buckets by seeded hashes:
the shard is a consistent-hash function of doc_id and the shard count alone
(law `key`: with one more shard, records move only into the new one), the
bucket within the shard a second hash, of doc_id, text and the number of the
task that read the record. Pass two
Fisher-Yates-shuffles each bucket in one task and writes it. The bytes of each
shard are counted first and give its number of buckets of `bucket_bytes`, so a
task's memory grows neither with the input nor with a shard that many rows of
one key make hot.

Defined cases: a null text has no bytes (size 8, crc32 of nothing is 0) and a
null doc_id is hashed as -1; copies of a text under different ids scatter like
any other records; repeated rows all stay; an empty table gives no rows;
other columns travel along, and a clash with an output name raises.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """Shard with the largest seeded hash; adding a shard takes keys only into itself."""
    weights = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("w"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(weights)["s"]


def external_shuffle(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = 16 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes every record with its shard, slot in the shard and the other contract columns; returns the written table.

    Slots count from 0 in each shard without gaps: a bucket's offset is the
    running row count of the shard's earlier buckets, plus the place that the
    Fisher-Yates shuffle gave.
    """
    if clash := {*OWN, "bucket", "place"} & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    k = F.coalesce(F.col(key).cast("long"), F.lit(-1))
    sized = docs.withColumns(
        {
            "size": F.octet_length(body).cast("long") + 8,
            "text_crc32": F.crc32(body).cast("long"),
            "law": F.lit("key"),
            "shard": rendezvous(k, shards, seed),
            "grown_shard": rendezvous(k, shards + 1, seed),
        }
    )
    held = {r["shard"]: r["b"] for r in sized.groupBy("shard").agg(F.sum(F.col("size") + 56).alias("b")).collect()}  # a number for each shard
    many = [max(1, math.ceil(held.get(s, 0) / bucket_bytes)) for s in range(shards)]
    first = [sum(many[:s]) for s in range(shards)]
    of = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("shard")).cast("long")
    # equal rows of different tasks part ways too, so that no number of them is one bucket
    scatter = F.pmod(F.xxhash64(F.lit(seed + 1), k, F.col(text), F.spark_partition_id()), of(many))
    scattered = sized.withColumn("bucket", of(first) + scatter)
    schema = scattered.withColumn("place", F.lit(0).cast("long")).schema

    def mix(bucket: pa.Table) -> pa.Table:
        order = np.lexsort((bucket["text_crc32"].to_numpy(), bucket[key].fill_null(-1).to_numpy()))
        rng = np.random.default_rng([seed, bucket["bucket"][0].as_py()])
        rng.shuffle(order)  # Fisher-Yates
        return bucket.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    mixed = keep(scattered.groupBy("bucket").applyInArrow(mix, schema), "shards", "snappy")
    counts = mixed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    # a row for each bucket: running sums side by side for the shards
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    return mixed.join(offsets, "bucket").withColumn("slot", F.col("first") + F.col("place")).drop("first", "place")


def op6_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = external_shuffle(docs)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
