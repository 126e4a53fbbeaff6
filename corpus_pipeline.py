"""Corpus pipeline: language, near duplicates, long repeats, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. Each one's result is written and read again
before the next.

Defined cases: an empty table gives an empty table at every stage; other
columns pass through under any name, except those of an operator's own output,
which raise. Null, empty and letterless texts go at the language stage; where
they are given to a later one, near_duplicates and long_repeats keep such
rows, personal_data leaves the text as it is and pack gives the end token
alone. Of equal rows and near copies one stays, that of the smallest id, nulls
last. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm import jaccard_join, language_id, packing, pii, repeat_index
from utterlake.llm.scratch import drop, keep

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_a_batch(spark: SparkSession) -> None:
    """Whole texts go to Python and back: a fifth of the usual rows a batch bounds what an executor holds of them at a time. A stage's result is computed after the stage returns, so the setting outlives it; run() puts the session's own back."""
    spark.conf.set(BATCH, "2000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: no letters, or far from every centroid. Rejected labels never count."""
    few_a_batch(spark)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    few_a_batch(spark)
    return jaccard_join.keep_one(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes and more that occur elsewhere; texts of which nothing is left go."""
    few_a_batch(spark)
    cut = repeat_index.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0)).withColumn("text", text).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of what is left into sequences of at most 4096."""
    few_a_batch(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", long_repeats),
    ("pii", personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is dropped once the next one is written; the last one stays for the result. The session's settings are as before at the end."""
    docs, written, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, spark.conf.get(BATCH)
    try:
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir), "stage", "snappy")
            if written is not None:
                drop(written)
            written = docs
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(BATCH, before)
