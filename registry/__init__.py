"""The registered queries and, next to each, the SQL that must give the same rows.

Every module holds ``QUERIES`` (key -> function of session and folder) and ``SQL`` (key -> text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **others: int) -> DataFrame:
    """DOUBLE columns rounded, so that the order of additions does not show."""
    return df.select(*[
        F.round(f"`{f.name}`", others.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def union(columns: list[str], template: str) -> str:
    """The SELECT once per column, ``{c}`` standing for its name."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)


def large(query):
    """The query with exact quantiles as large tables take them, whatever the size."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        key = "tableglass.quantiles.bufferRows"
        before = spark.conf.get(key, None)
        spark.conf.set(key, "0")
        try:
            return query(spark, folder)  # the way is chosen as the plan is made
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return run
