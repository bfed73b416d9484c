"""Finding repeated rows of wide tables while unique rows stay where they are.

A first pass counts 64-bit digests: eight bytes a row are shuffled, combined on the map side. Digests that occur once belong to
unique rows. The others are few as a rule; they are broadcast, up to a checked number of them, and only rows that
have one are compared whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableglass.functions.columns import is_floating
from tableglass.plans.scratch import scratch_folder

WIDE_BYTES = 100  # rows estimated narrower are shuffled as they are: a digest would save little
MOST_REPEATED = 1_000_000  # digests that are broadcast, 8 MB of them; beyond that whole rows are shuffled
DIGEST, AGAIN = "__tg_digest", "__tg_again"
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "boolean": 1}
TEXT_BYTES, NESTED_BYTES = 20, 50  # as estimated


def row_bytes(schema: T.StructType) -> int:
    """The estimated width of a row."""
    def width(t: T.DataType) -> int:
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            return NESTED_BYTES
        return TEXT_BYTES if isinstance(t, (T.StringType, T.BinaryType)) else WIDTHS.get(t.simpleString(), 8)
    return sum(width(f.dataType) for f in schema.fields)


def digest(columns: Sequence[Column], schema: T.StructType) -> Column:
    """Equal for equal rows; NULL differs from other values, and 0.0 not from -0.0."""
    parts = []
    for c, f in zip(columns, schema.fields):
        parts += [c + F.lit(0.0).cast(f.dataType) if is_floating(f.dataType) else c, c.isNull()]
    return F.xxhash64(*parts)


def split_repeats(df: DataFrame, columns: Sequence[Column], wide_bytes: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows that occur once, rows that may occur again); the first is None where the table is narrow or nearly all digests repeat.

    ``columns`` are the table's columns in comparable form. Which digests repeat is written to the shared folder and counted.
    """
    least = WIDE_BYTES if wide_bytes is None else wide_bytes
    if not df.columns or row_bytes(df.schema) < least:
        return None, df
    path = scratch_folder(df.sparkSession)
    df.groupBy(digest(columns, df.schema).alias(DIGEST)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(DIGEST).write.parquet(path)
    repeated = df.sparkSession.read.schema(f"{DIGEST} bigint").parquet(path)
    if repeated.count() > MOST_REPEATED:
        return None, df
    marked = df.withColumn(DIGEST, digest(columns, df.schema))
    known = F.broadcast(repeated)
    return marked.join(known, DIGEST, "left_anti").drop(DIGEST), marked.join(known, DIGEST, "left_semi").drop(DIGEST)
