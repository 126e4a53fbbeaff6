"""The shared folder of the cluster."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="utterlake-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of our own in local mode, as in tests, and an error on a cluster: executors would write to disks that the others don't see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _own()
    return where.rstrip("/")
