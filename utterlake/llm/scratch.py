"""Tables kept in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the setting is absent, one of our own in local mode, as in tests, and an error on a cluster: executors would write to disks that the others don't see."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="utterlake-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/utterlake/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", codec).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def drop(df: DataFrame) -> None:
    """Deletes what keep() wrote for df, once nothing that is still to run reads it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._kept_at)
    path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
