"""Descriptive reports and column profiles. One aggregate per table, one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableglass.functions.columns import (
    BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, class_of, columns_of, data_bytes, field_of,
    from_micros, is_floating, is_integral, micros, number, percent, quoted, raw, value,
)
from tableglass.functions.moments import sample_kurtosis, sample_skewness
from tableglass.operators.stats import aggregate
from tableglass.plans.distinct import distinct_metric
from tableglass.plans.quantiles import quantile_columns
from tableglass.plans.reports import Metric, column_report

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}

# Thresholds of the reports.
ALMOST_EMPTY_PCT = 90.0
HIGH_CARDINALITY = 1000
CONTINUOUS_ABOVE = 20
DATE_SHARE, EMAIL_SHARE, LONG_TEXT_CHARS = 0.5, 0.3, 100
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
INT16_LIMIT, FLOAT32_LIMIT = 32767, 1e38
CATEGORY_RATIO, CATEGORY_LIMIT = 0.5, 1000


def kind(df: DataFrame, column: str) -> str:
    return class_of(field_of(df, column).dataType)


def rows(df: DataFrame, column: str) -> Column:
    return F.count(F.lit(1))


def non_null(df: DataFrame, column: str) -> Column:
    return F.count(value(df, column))


def missing(df: DataFrame, column: str) -> Column:
    return F.count(F.lit(1)) - F.count(value(df, column))


def null_pct(df: DataFrame, column: str) -> Column:
    return percent(missing(df, column), rows(df, column))


def of_class(classes: Sequence[str], metric, type_name: str):
    """The metric for columns of these classes, a typed NULL for the others."""
    def pick(df: DataFrame, column: str) -> Column:
        if kind(df, column) in classes:
            return metric(df, column).cast(type_name)
        return F.lit(None).cast(type_name)
    return pick


def numeric(statistic: str, classes: Sequence[str] = (NUMERIC,)):
    return of_class(classes, lambda df, c: aggregate(df, c, statistic), "double")


def dated(statistic: str):
    def metric(df: DataFrame, c: str) -> Column:
        if statistic == "mean":
            data_type = field_of(df, c).dataType
            return from_micros(F.avg(micros(raw(c), data_type).cast("decimal(20,0)")), data_type)
        return getattr(F, statistic)(raw(c))
    return of_class([DATETIME], metric, "timestamp_ntz")


def describe_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, unique, top, freq (text and booleans), mean, std, min, quartiles
    and max (numbers as DOUBLE, dates in the ``dt_`` columns)."""
    columns = list(columns or df.columns)
    described = [c for c in columns if kind(df, c) in (CATEGORICAL, BOOLEAN)]
    measured = [c for c in columns if kind(df, c) in (NUMERIC, DATETIME)]
    report = column_report(df, columns, {
        "count": non_null,
        "mean": numeric("mean"), "std": numeric("std"), "min": numeric("min"), "max": numeric("max"),
        "dt_mean": dated("mean"), "dt_min": dated("min"), "dt_max": dated("max"),
    })
    tops = top_values(df, described, 1).groupBy("column").agg(
        F.max("unique").alias("unique"), F.max("value").alias("top"), F.max("count").alias("freq"))
    quartiles = quantile_columns(df, measured, QUARTILES) if measured else None
    out = report.join(F.broadcast(tops), "column", "left")
    dates = [c for c in columns if kind(df, c) == DATETIME]
    is_date = F.col("column").isin(dates)
    zoneless = F.col("column").isin([c for c in dates if isinstance(field_of(df, c).dataType, T.TimestampNTZType)])

    def clock(q: str) -> Column:
        return F.when(zoneless, from_micros(F.col(q), T.TimestampNTZType())).otherwise(
            from_micros(F.col(q), T.TimestampType()).cast("timestamp_ntz"))
    if quartiles is None:
        out = out.select("*", *[F.lit(None).cast("double").alias(q) for q in QUARTILES])
    else:
        out = out.join(F.broadcast(quartiles), "column", "left")
    return out.select(
        "column", "count", "unique", "top", "freq", "mean", "std", "min",
        *[F.when(~is_date, F.col(q)).alias(q) for q in QUARTILES], "max", "dt_mean", "dt_min",
        *[F.when(is_date, clock(q)).alias(f"dt_{q}") for q in QUARTILES],
        "dt_max")


def top_values(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """(column, value, count, unique, place): the n most frequent values of each column as text.

    The columns are counted together; the ranking keeps n rows per column and task before it
    shuffles, so a column of many values never meets in one task.
    """
    schema = "column string, value string, count bigint, unique bigint, place int"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    texts = df.select(*[value(df, c).cast("string").alias(c) for c in columns])
    counts = texts.unpivot([], [quoted(c) for c in columns], "column", "value").filter(
        F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    best = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
    # asks for the counts as well, so that both branches share one shuffle
    unique = counts.groupBy("column").agg(F.count_if(F.col("count") > 0).alias("unique"))
    return ranked.join(F.broadcast(unique), "column").select("column", "value", "count", "unique", "place")


def describe_numeric(df: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) of the numeric columns."""
    columns = columns_of(df, NUMERIC)
    if not columns:
        raise ValueError("the table has no numeric column")
    report = column_report(df, columns, {
        "count": non_null, "mean": numeric("mean"), "std": numeric("std"),
        "min": numeric("min"), "max": numeric("max")})
    return report.join(F.broadcast(quantile_columns(df, columns, QUARTILES)), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_enriched(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """:func:`describe_all` with cv, skewness, kurtosis, iqr, range and null_pct; 4 decimal places."""
    columns = list(columns or df.columns)
    extra = column_report(df, columns, {
        "skewness": of_class([NUMERIC], lambda frame, c: sample_skewness(number(frame, c)), "double"),
        "kurtosis": of_class([NUMERIC], lambda frame, c: sample_kurtosis(number(frame, c)), "double"),
        "null_pct": null_pct,
    })
    d = describe_all(df, columns)
    wide = d.join(F.broadcast(extra), "column").select(
        *[F.col(c) for c in d.columns],
        F.try_divide("std", "mean").alias("cv"), "skewness", "kurtosis",
        (F.col("p75") - F.col("p25")).alias("iqr"), (F.col("max") - F.col("min")).alias("range"), "null_pct")
    return wide.select(*[
        F.round(f.name, 4).alias(f.name) if is_floating(f.dataType) else F.col(f.name) for f in wide.schema.fields])


def column_classes(df: DataFrame) -> DataFrame:
    """(column, class, non_null): how each column is treated."""
    return column_report(df, df.columns, {
        "class": lambda frame, c: F.lit(kind(frame, c)), "non_null": non_null})


def column_bytes(df: DataFrame) -> DataFrame:
    """(column, bytes) with the estimated data size, and the total as column ``*``."""
    report = column_report(df, df.columns, {"bytes": data_bytes})
    whole = df.agg(sum((data_bytes(df, c) for c in df.columns), F.lit(0).cast("long")).alias("bytes"))
    return report.unionAll(whole.select(F.lit("*").alias("column"), "bytes"))


def column_info(df: DataFrame) -> DataFrame:
    """(column, type, non_null, null, unique, bytes, min, max, mean, std, dt_min, dt_max)."""
    measured = (NUMERIC, BOOLEAN)
    return column_report(df, df.columns, {
        "type": type_name, "non_null": non_null, "null": missing, "unique": distinct_metric(df, df.columns),
        "bytes": data_bytes,
        "min": numeric("min", measured), "max": numeric("max", measured), "mean": numeric("mean", measured),
        "std": of_class(measured, lambda frame, c: F.stddev_samp(number(frame, c)), "double"),
        "dt_min": dated("min"), "dt_max": dated("max"),
    })


def type_name(df: DataFrame, column: str) -> Column:
    return F.lit(field_of(df, column).dataType.simpleString())


def share(condition: Column) -> Column:
    """Aggregate: how many of all rows meet the condition; NULL rows do not. NULL for no rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def logical_type(unique: Metric) -> Metric:
    """What a column seems to hold."""
    def metric(df: DataFrame, column: str) -> Column:
        data_class = kind(df, column)
        if data_class == DATETIME:
            return F.lit("datetime")
        if data_class in (NUMERIC, BOOLEAN):
            n = unique(df, column)
            return F.when(n == 2, "binary_numeric").when(n > CONTINUOUS_ABOVE, "continuous").otherwise("discrete")
        if data_class == CATEGORICAL:
            c = raw(column)
            return (
                F.when(share(c.rlike(ISO_DATE)) > DATE_SHARE, "likely_date")
                .when(share(c.contains("@")) > EMAIL_SHARE, "likely_email")
                .when(F.avg(F.char_length(c)) > LONG_TEXT_CHARS, "long_text")
                .otherwise("short_text"))
        return F.lit("other")
    return metric


def unique_ratio(unique: Metric) -> Metric:
    return lambda df, column: F.try_divide(unique(df, column).cast("double"), rows(df, column).cast("double"))


def suggested_type(unique: Metric) -> Metric:
    """A narrower type the values would fit."""
    ratio = unique_ratio(unique)

    def metric(df: DataFrame, column: str) -> Column:
        data_type = field_of(df, column).dataType
        if is_integral(data_type):
            return F.when(F.max(raw(column)) < INT16_LIMIT, "int32 or int16").otherwise("int64")
        if is_floating(data_type):
            return F.when(F.max(value(df, column)) < FLOAT32_LIMIT, "float32").otherwise("float64")
        own = type_name(df, column)
        if kind(df, column) == CATEGORICAL:
            return F.when(ratio(df, column) < CATEGORY_RATIO, "category").otherwise(own)
        return own
    return metric


def logical_types(df: DataFrame) -> DataFrame:
    """(column, logical_type)."""
    return column_report(df, df.columns, {"logical_type": logical_type(distinct_metric(df, df.columns))})


def suggest_types(df: DataFrame) -> DataFrame:
    """(column, suggested_type)."""
    return column_report(df, df.columns, {"suggested_type": suggested_type(distinct_metric(df, df.columns))})


def dtypes_report(df: DataFrame) -> DataFrame:
    """(column, type, logical_type, nullable, non_null, null, unique, unique_ratio, bytes, suggested_type)."""
    unique = distinct_metric(df, df.columns)
    ratio = unique_ratio(unique)
    return column_report(df, df.columns, {
        "type": type_name, "logical_type": logical_type(unique),
        "nullable": lambda frame, c: missing(frame, c) > 0,
        "non_null": non_null, "null": missing, "unique": unique,
        "unique_ratio": lambda frame, c: F.round(F.coalesce(ratio(frame, c), F.lit(0.0)), 4),
        "bytes": data_bytes, "suggested_type": suggested_type(unique),
    })


def detect_categorical(df: DataFrame) -> DataFrame:
    """(column, unique, ratio, is_category) of the text columns."""
    texts = columns_of(df, CATEGORICAL)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, unique bigint, ratio double, is_category boolean")
    counted = column_report(df, texts, {"unique": distinct_metric(df, texts), "rows": rows})
    ratio = F.try_divide(F.col("unique").cast("double"), F.col("rows").cast("double"))
    return counted.select(
        "column", "unique", ratio.alias("ratio"),
        F.coalesce((ratio < CATEGORY_RATIO) & (F.col("unique") < CATEGORY_LIMIT), F.lit(False)).alias("is_category"))


def profile_overview(df: DataFrame) -> DataFrame:
    """(rows, columns, bytes, numeric_columns, categorical_columns, datetime_columns)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        sum((data_bytes(df, c) for c in df.columns), F.lit(0).cast("long")).alias("bytes"),
    ).select("rows", F.lit(len(df.columns)).alias("columns"), "bytes", *[
        F.lit(len(columns_of(df, c))).alias(f"{c}_columns") for c in (NUMERIC, CATEGORICAL, DATETIME)])


def profile_metrics(df: DataFrame) -> dict[str, Metric]:
    return {"type": type_name, "rows": rows, "null_count": missing, "null_pct": null_pct,
            "unique_count": distinct_metric(df, df.columns), "bytes": data_bytes}


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, type, null_count, null_pct, unique_count, bytes)."""
    return shown_columns(column_report(df, df.columns, profile_metrics(df)))


def shown_columns(facts: DataFrame) -> DataFrame:
    return facts.select("column", "type", "null_count", F.round("null_pct", 2).alias("null_pct"),
                        "unique_count", "bytes")


NUMBERS = {
    "min": numeric("min"), "max": numeric("max"), "mean": numeric("mean"), "std": numeric("std"),
    "zeros": of_class([NUMERIC], lambda df, c: F.count_if(number(df, c) == 0.0), "bigint"),
    "negatives": of_class([NUMERIC], lambda df, c: F.count_if(number(df, c) < 0.0), "bigint"),
}


def profile_numeric(df: DataFrame) -> DataFrame:
    """(column, min, max, mean, std, zeros, negatives) of the numeric columns."""
    return column_report(df, columns_of(df, NUMERIC), NUMBERS)


def profile_categorical(df: DataFrame, n: int = 5) -> DataFrame:
    """(column, value, count, is_boolean): the n most frequent values of each text column."""
    return top_values(df, columns_of(df, CATEGORICAL), n).select(
        "column", "value", "count", (F.col("unique") == 2).alias("is_boolean"))


def profile_warnings(df: DataFrame) -> DataFrame:
    """(warning, column, severity, measure): what looks wrong with a column.

    The measure is the null percentage, or the number of distinct values.
    """
    return warnings_from(column_report(df, df.columns, profile_metrics(df)), df)


def warnings_from(facts: DataFrame, df: DataFrame) -> DataFrame:
    texts = columns_of(df, CATEGORICAL)
    unique = F.col("unique_count")
    ids = F.lower("column").contains("id") & (unique == F.col("rows"))
    checks = [
        ("almost_empty", "high", F.col("null_pct") > ALMOST_EMPTY_PCT, F.col("null_pct")),
        ("constant", "medium", unique == 1, unique.cast("double")),
        ("high_cardinality", "medium", F.col("column").isin(texts) & (unique > HIGH_CARDINALITY), unique.cast("double")),
        ("potential_id", "low", ids, unique.cast("double")),
    ]
    found = [
        F.when(condition, F.struct(F.lit(name).alias("warning"), "column", F.lit(severity).alias("severity"),
                                   measure.alias("measure")))
        for name, severity, condition, measure in checks
    ]
    return facts.select(F.inline(F.array_compact(F.array(*found))))


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """All profile tables; the one aggregate behind columns, numbers and warnings is kept in memory
    (one row per column) so that it runs once."""
    facts = column_report(df, df.columns, {**profile_metrics(df), **NUMBERS}).persist()
    return {
        "overview": profile_overview(df),
        "columns": shown_columns(facts),
        "numeric": facts.filter(F.col("column").isin(columns_of(df, NUMERIC))).select("column", *NUMBERS),
        "categorical": profile_categorical(df),
        "warnings": warnings_from(facts, df),
    }


def explore(df: DataFrame, exploration: str = "profile", **options):
    """Dispatch by name, for callers that keep the choice in data."""
    from tableglass.operators import correlate
    from tableglass.operators import rows as row_ops
    choices = {
        "profile": profile, "describe": describe_enriched, "correlation": correlate.correlation,
        "dtypes": dtypes_report, "head": row_ops.head, "tail": row_ops.tail, "sample": row_ops.sample_rows,
    }
    if exploration not in choices:
        raise ValueError(f"unknown exploration {exploration!r}; use one of {list(choices)}")
    return choices[exploration](df, **options)
