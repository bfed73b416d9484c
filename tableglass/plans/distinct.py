"""Exact numbers of distinct values of many columns in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.functions.columns import (
    CATEGORICAL, DATETIME, OTHER, class_of, field_of, groupable, is_floating, is_integral, micros, raw, value,
)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique): columns without values are left out.

    Several ``count(DISTINCT)`` in one aggregate copy each row once per column, every copy as wide
    as all of them. Here a copy holds just one value, in the lane of its kind, and equal values
    meet already on the map side.
    """
    def lane(place: int, c: str) -> Column:
        data_type = field_of(df, c).dataType
        kind = class_of(data_type)
        number, whole, text = F.lit(None).cast("double"), F.lit(None).cast("bigint"), F.lit(None).cast("string")
        if is_floating(data_type):
            number = value(df, c).cast("double")
        elif is_integral(data_type):
            whole = raw(c).cast("bigint")
        elif kind == DATETIME:
            whole = micros(raw(c), data_type)
        elif kind == OTHER:
            text = F.to_json(F.when(raw(c).isNotNull(), F.struct(groupable(raw(c), data_type).alias("v"))))
        else:
            text = raw(c) if kind == CATEGORICAL else raw(c).cast("string")
        return F.struct(F.lit(place).alias("place"), number.alias("number"), whole.alias("whole"), text.alias("text"))
    lanes = df.select(F.inline(F.array(*[lane(i, c) for i, c in enumerate(columns)])))
    values = lanes.filter("number IS NOT NULL OR whole IS NOT NULL OR text IS NOT NULL").groupBy(
        "place", "number", "whole", "text").agg(F.count(F.lit(1)).alias("copies"))
    names = F.array(*[F.lit(c) for c in columns])
    return values.groupBy("place").agg(F.count(F.lit(1)).alias("unique")).select(
        F.element_at(names, F.col("place") + 1).alias("column"), "unique")


def distinct_metric(df: DataFrame, columns: Sequence[str]) -> Callable[[DataFrame, str], Column]:
    """The counts as a scalar subquery (a map with one entry per column), to be used inside the
    aggregate of a report: counted apart, they do not slow down its other aggregates."""
    entries = F.map_from_entries(F.collect_list(F.struct("column", "unique"))).alias("unique")
    counts = distinct_counts(df, columns).agg(entries).scalar()
    return lambda frame, c: F.coalesce(F.try_element_at(counts, F.lit(c)), F.lit(0).cast("bigint"))
