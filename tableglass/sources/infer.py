"""Finding better types for the columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableglass.functions.columns import (
    CATEGORICAL, NUMERIC, columns_of, field_of, is_integral, raw, value,
)
from tableglass.operators.profile import detect_categorical
from tableglass.plans.reports import column_report

# The pattern of a date, the shares needed, and the formats tried in order.
DATE_LIKE = r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
DATE_LIKE_SHARE, PARSED_SHARE = 0.5, 0.8
DATE_FORMATS = ["", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy"]  # "" is ISO 8601
DAY, MONTH, YEAR = "(0?[1-9]|[12][0-9]|3[01])", "(0?[1-9]|1[0-2])", "[0-9]{4}"
PLAIN_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
FLOAT32_TOLERANCE = 5e-4
INTEGER_RANGES = {"tinyint": 2**7, "smallint": 2**15, "int": 2**31}


def shape_of(date_format: str) -> str:
    """The pattern of the texts a format can read. A failing parse costs far more than a failing match."""
    shape = date_format.replace(".", "[.]").replace("yyyy", "Y")
    return "^" + shape.replace("M", MONTH).replace("d", DAY).replace("Y", YEAR) + "$"


def parsed(column: Column, date_format: str) -> Column:
    text = F.trim(column)
    if not date_format:
        return F.try_to_timestamp(text)
    return F.when(text.rlike(shape_of(date_format)), F.try_to_timestamp(text, F.lit(date_format)))


def as_number(column: Column) -> Column:
    """A decimal comma reads as a point; white space does not count. Words for numbers (NaN, Infinity) and Java's suffixes (1d, 2f)
    are no numbers."""
    plain = F.regexp_replace(F.replace(column, F.lit(","), F.lit(".")), r"(?U)\s+", "")
    return F.when(plain.rlike(PLAIN_NUMBER), plain.try_cast("double"))


def ratio(part: Column) -> Column:
    """Aggregate: the share of all rows, nulls in the denominator."""
    return F.coalesce(F.try_divide(F.count(part).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))


def date_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, date_like, ratio_0...): how many values look like dates and parse in each format."""
    metrics = {"date_like": lambda frame, c: F.coalesce(F.avg(raw(c).rlike(DATE_LIKE).cast("double")), F.lit(0.0))}
    for i, date_format in enumerate(DATE_FORMATS):
        metrics[f"ratio_{i}"] = lambda frame, c, f=date_format: ratio(parsed(raw(c), f))
    return column_report(df, columns, metrics)


def date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The format to read each date column with; one row per column reaches the driver."""
    if not columns:
        return {}
    ratios = [F.col(f"ratio_{i}") for i in range(len(DATE_FORMATS))]
    best = F.greatest(*ratios)
    fitting = date_ratios(df, columns).filter((F.col("date_like") > DATE_LIKE_SHARE) & (best > PARSED_SHARE))
    chosen = fitting.select("column", (F.array_position(F.array(*ratios), best) - 1).cast("int").alias("format"))
    return {row["column"]: DATE_FORMATS[row["format"]] for row in chosen.collect()}


def text_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    texts = columns_of(df, CATEGORICAL)
    return texts if columns is None else [c for c in columns if c in texts]


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else raw(c) for c in df.columns]) if new else df


def infer_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become timestamps if most values look like dates and over 80 % of rows parse."""
    found = date_formats(df, text_columns(df, columns))
    return replaced(df, {c: parsed(raw(c), f) for c, f in found.items()})


def number_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    ratios = column_report(df, columns, {"ratio": lambda frame, c: ratio(as_number(raw(c)))})
    return [row["column"] for row in ratios.filter(F.col("ratio") > PARSED_SHARE).collect()]


def infer_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become DOUBLE if over 80 % of rows read as numbers."""
    return replaced(df, {c: as_number(raw(c)) for c in number_columns(df, text_columns(df, columns))})


def suggest_downcast(df: DataFrame) -> DataFrame:
    """(column, type, suggested): the narrowest integer type that holds the values, and float where
    every value survives it within 5e-4."""
    columns = columns_of(df, NUMERIC)

    def narrowest(frame: DataFrame, c: str) -> Column:
        data_type = field_of(frame, c).dataType
        own = data_type.simpleString()
        if is_integral(data_type):
            lo, hi = F.min(raw(c)), F.max(raw(c))
            best = F.when(lo.isNull(), own)
            for name, limit in INTEGER_RANGES.items():
                best = best.when((lo >= -limit) & (hi < limit), name)
            return best.otherwise(own)
        if isinstance(data_type, T.DoubleType):
            v = value(frame, c)
            loss = F.max(F.abs(v - v.cast("float").cast("double")))
            return F.when(loss <= FLOAT32_TOLERANCE, "float").otherwise(own)
        return F.lit(own)
    return column_report(df, columns, {
        "type": lambda frame, c: F.lit(field_of(frame, c).dataType.simpleString()),
        "suggested": narrowest,
    })


def infer_types(df: DataFrame, aggressive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, conversions): dates, with ``aggressive`` numbers, categories (a remark only, the
    values stay text) and narrower integers. Conversions are (column, conversion); a narrower float
    would change later sums and is not applied, see :func:`suggest_downcast`.

    All date formats, number readings and integer ranges are decided from aggregates over the table.
    """
    texts = columns_of(df, CATEGORICAL)
    dates = date_formats(df, texts)
    numbers = number_columns(df, [c for c in texts if c not in dates]) if aggressive else []
    new = {c: parsed(raw(c), f) for c, f in dates.items()} | {c: as_number(raw(c)) for c in numbers}
    integers = [f.name for f in df.schema.fields if is_integral(f.dataType)]
    narrow = suggest_downcast(df.select(*[raw(c) for c in integers])).filter(
        F.col("type") != F.col("suggested")).collect() if integers else []
    new |= {row["column"]: raw(row["column"]).cast(row["suggested"]) for row in narrow}
    table = replaced(df, new)

    log = [(c, "string → datetime") for c in dates] + [(c, "string → numeric") for c in numbers]
    log += [(row["column"], f"{row['type']} → {row['suggested']}") for row in narrow]
    lines = df.sparkSession.createDataFrame(log, "column string, conversion string")
    left = [c for c in texts if c not in new]
    if left:
        categories = detect_categorical(df.select(*[raw(c) for c in left])).filter("is_category")
        lines = lines.unionAll(categories.select("column", F.lit("string → category").alias("conversion")))
    return table, lines
