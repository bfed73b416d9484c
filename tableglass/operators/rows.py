"""Choosing columns and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.functions.columns import field_of, groupable, is_floating, micros, raw

COMPARISONS = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v,
}


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        field_of(df, c)
    return df.select(*[raw(c) for c in columns])


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """The table without the column; the table itself where there is none."""
    return df.select(*[raw(c) for c in df.columns if c != column])


def not_nan(df: DataFrame, column: str) -> Column:
    """NaN counts as missing and so passes no comparison; kept apart so the rest is pushed down."""
    if is_floating(field_of(df, column).dataType):
        return ~F.isnan(raw(column))
    return F.lit(True)


def filter_compare(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows where ``column op value``, with op one of > < >= <= ==."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; use one of {list(COMPARISONS)}")
    return df.filter(COMPARISONS[op](raw(column), F.lit(value)) & not_nan(df, column))


def filter_between(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Rows where the column lies in [low, high]."""
    return df.filter(raw(column).between(F.lit(low), F.lit(high)) & not_nan(df, column))


def datetime_to_epoch(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """Adds the date column as epoch microseconds (``<column>_epoch`` unless named)."""
    return df.withColumn(to or f"{column}_epoch", micros(raw(column), field_of(df, column).dataType))


def ordering(order_by: Sequence[str] | str, descending: bool = False) -> list[Column]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return [raw(c).desc_nulls_first() if descending else raw(c).asc_nulls_last() for c in names]


def head(df: DataFrame, order_by: Sequence[str] | str, n: int = 10) -> DataFrame:
    """The first n rows in the order named."""
    return df.orderBy(*ordering(order_by)).limit(n)


def tail(df: DataFrame, order_by: Sequence[str] | str, n: int = 10) -> DataFrame:
    """The last n rows in the order named, in that order."""
    return df.orderBy(*ordering(order_by, descending=True)).limit(n).orderBy(*ordering(order_by))


def sample_rows(df: DataFrame, n: int = 10, seed: int = 42, key: Sequence[str] | str | None = None) -> DataFrame:
    """n rows without replacement, the same for the same seed: those with the n least MD5 sums of ``seed|key...`` (the key's
    columns as text, missing ones left out).

    ``key`` should tell rows apart; by default it is the whole row.
    """
    names = list(df.columns) if key is None else [key] if isinstance(key, str) else list(key)
    parts = [groupable(raw(c), field_of(df, c).dataType) for c in names]
    texts = [p.cast("string") for p in parts]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), *parts).limit(n)


def sort_rows(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows sorted by the column, missing values last either way."""
    return df.orderBy(raw(column).asc_nulls_last() if ascending else raw(column).desc_nulls_last())
