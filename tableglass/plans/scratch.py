"""Where written intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``, or in the warehouse where that is unset: both are shared by
    all executors of a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/tableglass-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table that several passes read."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
