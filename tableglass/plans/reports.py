"""Reports with one row per column, computed by one aggregate over the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.functions.columns import raw

Metric = Callable[[DataFrame, str], Column]


def column_report(
    df: DataFrame, columns: Sequence[str], metrics: dict[str, Metric], by: Sequence[str] = (),
) -> DataFrame:
    """(by..., column, metrics...): every metric is an aggregate of one type for all columns."""
    aggregates = [
        metric(df, c).alias(f"m{i}_{name}") for i, c in enumerate(columns) for name, metric in metrics.items()
    ]
    row = df.groupBy(*[raw(b) for b in by]).agg(*aggregates) if by else df.agg(*aggregates)
    lines = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"m{i}_{name}").alias(name) for name in metrics])
        for i, c in enumerate(columns)
    ]
    return row.select(*[raw(b) for b in by], F.inline(F.array(*lines)))


def scalars(df: DataFrame, **aggregates: Column) -> Column:
    """The one-row aggregate as a struct-valued scalar subquery, for use in any other query."""
    return df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("scalars")).scalar()
