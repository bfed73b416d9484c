"""Cleaning operations and pipelines of them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.functions.columns import (
    CATEGORICAL, NUMERIC, class_of, clean, field_of, has_map, number, value,
)
from tableglass.operators.quality import whole_rows
from tableglass.operators.rows import drop_column
from tableglass.operators.stats import mode_of
from tableglass.plans.quantiles import exact_quantiles
from tableglass.plans.repeats import split_repeats

REPORT = "step int, type string, column string, method string, rows_before bigint, rows_after bigint, " \
         "rows_removed bigint, filled bigint"


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each group of identical rows. Unique rows of a wide table stay where they are."""
    alone, others = split_repeats(df, whole_rows(df))
    first = first_of_each(others)
    return first if alone is None else first.unionByName(clean(alone))


def first_of_each(df: DataFrame) -> DataFrame:
    table = clean(df)
    if not any(has_map(f.dataType) for f in df.schema.fields):
        return table.dropDuplicates()
    grouped = df.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(whole_rows(df))])
    return grouped.agg(F.first(F.struct(*[value(df, c).alias(c) for c in df.columns])).alias("row")).select("row.*")


def fill_statistic(df: DataFrame, column: str, method: str) -> Column | None:
    """The value to fill with, as a scalar subquery; None where the method does not apply."""
    is_number = class_of(field_of(df, column).dataType) == NUMERIC
    if method == "mean" and is_number:
        return df.agg(F.avg(number(df, column)).alias("fill")).scalar()
    if method == "median" and is_number:
        return exact_quantiles(df, [column], [0.5]).select("quantile").scalar()
    if method == "mode":
        return mode_of(df, column).scalar()
    return None


def fill(df: DataFrame, column: str, method: str, constant: Any = "UNKNOWN") -> DataFrame:
    """The column with its missing values replaced; other methods and types leave it alone."""
    return fill_many(df, {column: (method, constant)})


def fill_many(df: DataFrame, fills: dict[str, tuple[str, Any]]) -> DataFrame:
    """Several columns filled from statistics of the same table, in one projection."""
    for c in fills:
        field_of(df, c)
    filled = []
    for c in df.columns:
        v = value(df, c)
        if c in fills:
            method, constant = fills[c]
            v = filled_column(df, c, method, constant)
        filled.append(v.alias(c))
    return df.select(*filled)


def filled_column(df: DataFrame, column: str, method: str, constant: Any) -> Column:
    v = value(df, column)
    if method == "constant":
        # text put into a column of another type makes the column text
        is_text = class_of(field_of(df, column).dataType) == CATEGORICAL
        return F.coalesce(v.cast("string") if isinstance(constant, str) and not is_text else v, F.lit(constant))
    found = fill_statistic(df, column, method)
    if found is None:
        return v
    if method == "mode":
        return F.coalesce(v, found)
    return F.coalesce(number(df, column), found)


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    """Numeric columns only; an integer column becomes DOUBLE."""
    return fill(df, column, "mean")


def fill_median(df: DataFrame, column: str) -> DataFrame:
    return fill(df, column, "median")


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """Any type; a column without values stays as it is."""
    return fill(df, column, "mode")


def fill_constant(df: DataFrame, column: str, constant: Any = "UNKNOWN") -> DataFrame:
    return fill(df, column, "constant", constant)


def clean_pipeline(
    df: DataFrame, operations: Sequence[dict[str, Any]], checkpoint: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Applies the operations in order and reports on each: (cleaned table, report).

    Operations are ``{"type": "remove_duplicates"}``, ``{"type": "drop_column", "column": c}`` and
    ``{"type": "fill_missing", "column": c, "method": mean|median|mode|constant, "value": v}``. Steps
    naming an absent column, or of an unknown type, are passed over.

    Fills in a row on different columns read their statistics from the same table, so they share
    its scan. ``checkpoint`` stores the table after each removal of duplicates in the folder of
    ``spark.checkpoint.dir``, so that statistics taken later do not repeat the removal.
    """
    table, report, pending = df, [], {}

    def settle(frame: DataFrame) -> DataFrame:
        done = fill_many(frame, pending) if pending else frame
        pending.clear()
        return done

    for step, op in enumerate(operations, start=1):
        kind, column = op.get("type"), op.get("column")
        if kind == "remove_duplicates":
            before = settle(table)
            table = remove_duplicates(before)
            if checkpoint:
                table = table.checkpoint()
            n = {"rows_before": counted(before), "rows_after": counted(table)}
            report.append(entry(df, step, kind, n))
        elif kind == "fill_missing" and column in table.columns:
            if column in pending:
                table = settle(table)
            method = op.get("method", "mean")
            constant = op.get("value", "UNKNOWN")
            report.append(entry(df, step, kind, {"filled": fillable(table, column, method, constant)}, column, method))
            pending[column] = (method, constant)
        elif kind == "drop_column" and column in table.columns:
            pending.pop(column, None)
            table = drop_column(settle(table), column)
            report.append(entry(df, step, kind, {}, column))
    table = settle(table)
    lines = report[0] if report else df.sparkSession.createDataFrame([], REPORT)
    for line in report[1:]:
        lines = lines.unionAll(line)
    return table, lines


def counted(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("rows")).scalar()


def fillable(df: DataFrame, column: str, method: str, constant: Any) -> Column:
    """How many values the step fills: all missing ones, or none where it has nothing to fill with."""
    nulls = F.count(F.lit(1)) - F.count(value(df, column))
    is_number = class_of(field_of(df, column).dataType) == NUMERIC
    if method == "constant":
        able = F.lit(constant is not None)
    elif method == "mode" or (method in ("mean", "median") and is_number):
        able = F.count(value(df, column)) > 0
    else:
        able = F.lit(False)
    return df.agg(F.when(able, nulls).otherwise(F.lit(0).cast("long")).alias("filled")).scalar()


def entry(
    df: DataFrame, step: int, kind: str, numbers: dict[str, Column], column: str | None = None, method: str | None = None,
) -> DataFrame:
    """One line of the report, shaped as REPORT."""
    line = df.sparkSession.range(1).select(
        F.lit(step).cast("int").alias("step"), F.lit(kind).alias("type"),
        F.lit(column).cast("string").alias("column"), F.lit(method).cast("string").alias("method"),
        *[numbers.get(n, F.lit(None)).cast("bigint").alias(n) for n in ("rows_before", "rows_after", "filled")])
    return line.select("step", "type", "column", "method", "rows_before", "rows_after",
                       (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"), "filled")
