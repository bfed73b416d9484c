"""Ranks of values over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableglass.functions.columns import raw
from tableglass.plans.quantiles import log_bucket

VALUES_PER_PART = 100_000.0
FEW_VALUES = 1_000_000  # so many distinct values one task may sort


def few_values(distinct: int) -> bool:
    return distinct <= FEW_VALUES


def ordered_counts(counts: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """(keys..., value, cnt) with one row per value becomes (..., before, dense, total).

    ``before`` counts the rows with a smaller value, ``dense`` the smaller values, ``total`` all
    rows of the key. Where a key is known to have ``few`` values they are ranked by one window.
    Otherwise they are split into ordered parts: by size (sign and log2), and each of those into
    equal slices, as many as its values need. A running sum over the parts gives each part its
    offset, and a window inside the part the rest.
    """
    by = [raw(k) for k in keys]
    if few:
        key = Window.partitionBy(*by)
        up = key.orderBy("value")
        return counts.select(
            *by, "value", "cnt",
            (F.sum("cnt").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cnt")).alias("before"),
            (F.row_number().over(up) - 1).cast("bigint").alias("dense"), F.sum("cnt").over(key).alias("total"))
    placed = counts.withColumn("bucket", log_bucket(F.col("value")))
    sizes = placed.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("values"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    slices = F.ceil(F.col("values") / VALUES_PER_PART).cast("double")
    width = F.col("hi") - F.col("lo")
    parts = placed.join(sizes, [*keys, "bucket"]).withColumn(
        "part", F.when((width > 0.0) & (width < float("inf")), F.floor((F.col("value") - F.col("lo")) / width * slices))
        .otherwise(F.lit(0).cast("long"))).drop("values", "lo", "hi")
    order = Window.partitionBy(*by).orderBy("bucket", "part")
    offsets = (
        parts.groupBy(*by, "bucket", "part")
        .agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("values"))
        .select(
            *by, "bucket", "part",
            (F.sum("rows").over(order) - F.col("rows")).alias("rows_before"),
            (F.sum("values").over(order) - F.col("values")).alias("values_before"),
            F.sum("rows").over(Window.partitionBy(*by)).alias("total"))
    )
    inside = Window.partitionBy(*by, "bucket", "part").orderBy("value")
    ranked = parts.withColumn("upto", F.sum("cnt").over(inside)).withColumn("place", F.row_number().over(inside))
    return ranked.join(offsets, [*keys, "bucket", "part"]).select(
        *by, "value", "cnt",
        (F.col("rows_before") + F.col("upto") - F.col("cnt")).alias("before"),
        (F.col("values_before") + F.col("place") - 1).alias("dense"), "total")
