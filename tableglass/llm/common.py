"""What several operators share: written intermediate tables, null-safe lookups that survive hot keys, small expressions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group of more than this share of all rows is hot; so there are at most HOT_SHARE hot groups, whatever the size.
HOT_SHARE = 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends here, and what a task has numbered stays.

    The shuffle files of the job are deleted when it ends: nothing reads them any more.
    """
    path, spark = shared_path(df.sparkSession, name), df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python in batches of at most 8 MB, so that a task's memory doesn't grow with its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system, where the allocators would keep it for the worker's life."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lookup(values: DataFrame, groups: DataFrame, on: Sequence[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """Each row of ``values`` with its group's row; ``groups`` holds one row a key and its number of rows in ``rows``.

    Groups of more than total / HOT_SHARE rows are broadcast (there can be no more than HOT_SHARE of them), the others meet
    their rows in a shuffle, so no key brings an unbounded number of rows into one task. Keys must not be null.
    """
    on = list(on)
    limit = max(total // HOT_SHARE, 1000)
    if total <= limit:
        return values.join(F.broadcast(groups), on, how)  # fewer rows than one hot group needs
    hot = groups.filter(F.col(rows) > limit)
    marked = values.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
    extra = [c for c in groups.columns if c not in on]
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot", *extra).join(groups.filter(F.col(rows) <= limit), on, how)
    return marked.filter("__hot").drop("__hot").unionByName(cold)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5
