"""Quality selection holds toxic texts back by a tail of their own and keeps good ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterlake.llm import quality


def test_few_toxic_texts_are_selected(spark):
    sf = "/root/testdata/sf0.1"
    g = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    d = spark.read.parquet(f"{sf}/documents.parquet").join(g, "doc_id")
    model = quality.fit(d.where("doc_id % 4 > 0").select(F.col("doc_id").alias("key"), "text", "grade"))
    assert model.toxic is not None and 0 < model.most_toxic < 1
    out = quality.score(d.where("doc_id % 4 = 0"), model).groupBy("grade").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()
    share = {r.grade: r.s for r in out}
    assert share[0] <= 0.15 and share[2] >= 0.95
