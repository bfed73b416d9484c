"""Writing tables and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableglass.operators.rows import head


def write_csv(df: DataFrame, path: str, n: int | None = None, order_by: Sequence[str] | str | None = None) -> None:
    """CSV files with a header: all rows, or the first n in the order named."""
    if n is not None:
        if order_by is None:
            raise ValueError("the first n rows need an order")
        df = head(df, order_by, n)
    df.write.csv(path, header=True, escape='"')
