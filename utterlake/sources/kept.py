"""Tables written once and read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..streaming.folder import shared_dir


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: what reads it again computes nothing again, and a lost executor costs no lineage."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
