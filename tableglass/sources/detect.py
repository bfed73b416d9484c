"""What separates the fields of a file and how its characters are stored."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableglass.sources.heads import heads

# The separators considered, in order of preference, and the bytes looked at.
SEPARATORS = [",", ";", "\t", "|", ":"]
SAMPLE_BYTES = 4096


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of the first block of each file, numbered in reading order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        "value", F.monotonically_increasing_id().alias("line")).filter(F.col("start") == 0).drop("start")


def separators(lines: DataFrame) -> DataFrame:
    """(file, separator): the separator most frequent in the first 4096 bytes, a comma if none.

    A line has at least its line break, so no more than 4096 lines per file can matter; the
    ranking drops the others inside the task that reads them.
    """
    order = Window.partitionBy("file").orderBy("line")
    few = lines.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_BYTES)
    length = F.octet_length("value")
    before = F.sum(length + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length - 1
    start = few.withColumn("before", before).filter(F.col("before") < SAMPLE_BYTES).select(
        "file", F.substring(F.col("value"), F.lit(1), (F.lit(SAMPLE_BYTES) - F.col("before")).cast("int")).alias("value"))

    return most_frequent(start, "value")


def most_frequent(texts: DataFrame, column: str) -> DataFrame:
    """(file, separator): of each file's texts the separator that occurs most, the earlier of equal ones, a comma if none."""
    def times(separator: str):
        return F.coalesce(F.sum(F.octet_length(column) - F.octet_length(F.replace(column, F.lit(separator), F.lit("")))), F.lit(0))
    counted = texts.groupBy("file").agg(*[times(s).alias(f"n{i}") for i, s in enumerate(SEPARATORS)])
    most = F.greatest(*[F.col(f"n{i}") for i in range(len(SEPARATORS))])
    best = F.when(most == 0, SEPARATORS[0])
    for i, s in enumerate(SEPARATORS):
        best = best.when(F.col(f"n{i}") == most, s)
    return counted.select("file", best.alias("separator"))


def separators_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, separator) from the first 4096 bytes of each file; only files whose beginning can't be read by itself are scanned."""
    known = heads(spark, path, SAMPLE_BYTES)
    apart = most_frequent(known.filter("head IS NOT NULL").select("file", F.col("head").cast("string").alias("value")), "value")
    others = sorted(file_name(r["file"]) for r in known.filter("head IS NULL").select("file").collect())
    return apart.unionByName(separators(numbered_lines(spark, others))) if others else apart


def detect_separator(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, separator) of every file."""
    return separators_of(spark, path)


def detect_encoding(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, encoding): UTF-16 or UTF-32 by byte order mark, UTF-8 if all bytes are valid, else
    ISO-8859-1. Lines arrive as raw bytes and every one is looked at, so the answer is not a guess
    from a prefix."""
    head = F.hex(F.substring(F.col("value").cast("binary"), 1, 4))
    facts = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").groupBy("file").agg(
        F.bool_or(head.startswith("FFFE0000") | head.startswith("0000FEFF")).alias("utf32"),
        F.bool_or(head.startswith("FFFE") | head.startswith("FEFF")).alias("utf16"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    return facts.select("file", F.when(F.col("utf32"), "UTF-32").when(F.col("utf16"), "UTF-16").when(
        F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def csv_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, separator, encoding) of every file that has a line."""
    return separators_of(spark, path).join(detect_encoding(spark, path), "file")


def file_name(uri: str) -> str:
    """The path to read a file by, from the URI that Spark shows."""
    return unquote(uri)
