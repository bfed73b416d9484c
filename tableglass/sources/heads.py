"""The first bytes of files, read on the executors: what a large file holds beyond them is not touched."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 4096
#: Spark gives a task at most 32 short files, as if it read them whole; to read heads a task takes so many times more.
FEWER_TASKS = 8
#: Files that Spark unpacks as it reads them; their first bytes say nothing.
PACKED = (".gz", ".gzip", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate")


def read_head(path: str, size: int) -> bytes | None:
    """The first bytes of a file, None where it is packed or in a store that only Spark's own readers reach."""
    from pyarrow import fs

    if path.lower().endswith(PACKED):
        return None
    parts = urlsplit(path)
    try:
        if parts.scheme in ("", "file"):
            store, name = fs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/")
        else:
            store, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        with store.open_input_file(name) as f:
            return f.read_at(min(size, f.size()), 0)
    except (OSError, ValueError, NotImplementedError, pa.ArrowInvalid):
        return None


def heads(spark: SparkSession, path: str | list[str], size: int = HEAD_BYTES) -> DataFrame:
    """(file, length, head) of every file that is not empty; ``head`` is NULL where it can't be read apart from the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_head(p.as_py(), size) for p in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["file", "length", "head"])
    # listed, not read: the column of contents is left out
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("_metadata.file_path").alias("file"), "path", "length")
    tasks = max(files.rdd.getNumPartitions() // FEWER_TASKS, spark.sparkContext.defaultParallelism)
    return files.coalesce(tasks).mapInArrow(run, "file string, length bigint, head binary")


def head_lines(head: Column, length: Column) -> Column:
    """The complete lines of a head, as an array of texts."""
    lines = F.split(head.cast("string"), "\r\n|\r|\n")
    return F.when(length <= F.octet_length(head), lines).otherwise(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
