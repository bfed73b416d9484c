"""Statistics of columns, over the whole table or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableglass.functions.columns import (
    BOOLEAN, DATETIME, NUMERIC, class_of, field_of, from_micros, groupable, is_integral, micros, number, percent,
    raw, value,
)
from tableglass.functions.moments import sample_kurtosis, sample_skewness
from tableglass.plans.distinct import distinct_counts
from tableglass.plans.names import free, keyed, unkeyed
from tableglass.plans.quantiles import exact_quantiles, quantile_columns
from tableglass.plans.reports import column_report

# The operation names a caller may use, with the name of the statistic.
OPERATIONS = {
    "moyenne": "mean",
    "somme": "sum",
    "minimum": "min",
    "maximum": "max",
    "mediane": "median",
    "ecart_type": "std",
    "variance": "variance",
    "count": "count",
    "percentile_25": "p25",
    "percentile_75": "p75",
}

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
MOMENTS = ("mean", "sum", "min", "max", "std", "variance", "count", "skewness", "kurtosis", "nunique",
           "null_count", "null_pct")
ALL = ("mean", "std", "min", "max", "median", "count")
GROUPED_ALL = ("mean", "sum", "min", "max", "median", "std", "count")
OF_DATES = ("mean", "min", "max", "median")


def canonical(operation: str) -> str:
    """The statistic meant; an unknown name means the table of all statistics."""
    name = OPERATIONS.get(operation, operation)
    return name if name in MOMENTS or name in QUARTILES or name in ("mode", "percentile") else "all"


def usable(df: DataFrame, columns: Sequence[str], operation: str = "mean") -> list[str]:
    """The named columns the statistic applies to; text is skipped, nothing left is an error."""
    allowed = {NUMERIC}
    if operation in ("mean", "sum", "min", "max", "count", "nunique", "null_count", "null_pct"):
        allowed.add(BOOLEAN)
    if operation in ("count", "nunique", "null_count", "null_pct", "mode"):
        return [c for c in columns if field_of(df, c)]
    if operation in OF_DATES:
        allowed.add(DATETIME)
    kept = [c for c in columns if class_of(field_of(df, c).dataType) in allowed]
    if not kept:
        raise ValueError(f"no column among {list(columns)} can be used for {operation!r}")
    return kept


def aggregate(df: DataFrame, column: str, statistic: str) -> Column:
    """One statistic of one column as an aggregate expression, in the column's natural type."""
    data_type = field_of(df, column).dataType
    if statistic == "count":
        return F.count(value(df, column))
    if statistic == "nunique":
        return F.count_distinct(groupable(value(df, column), data_type))
    if statistic == "null_count":
        return F.count(F.lit(1)) - F.count(value(df, column))
    if statistic == "null_pct":
        return percent(F.count(F.lit(1)) - F.count(value(df, column)), F.count(F.lit(1)))
    if class_of(data_type) == DATETIME:
        if statistic in ("min", "max"):
            return getattr(F, statistic)(raw(column))
        if statistic == "mean":
            return from_micros(F.avg(micros(raw(column), data_type).cast("decimal(20,0)")), data_type)
        raise ValueError(f"{statistic!r} is not defined for dates ({column!r})")
    whole = is_integral(data_type) or isinstance(data_type, T.DecimalType)
    v = value(df, column) if whole else number(df, column)
    if statistic == "sum":
        if is_integral(data_type):
            return F.coalesce(F.sum(v.cast("decimal(20,0)")), F.lit(0)).cast("bigint")
        return F.coalesce(F.sum(v), F.lit(0.0)).cast("double")
    if statistic in ("min", "max"):
        return getattr(F, statistic)(v)
    d = number(df, column)
    of_doubles = {
        "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp,
        "skewness": sample_skewness, "kurtosis": sample_kurtosis,
    }
    return of_doubles[statistic](d)


def stat(
    df: DataFrame, columns: Sequence[str] | str, operation: str = "all", *,
    p: float | None = None, accuracy: int | None = None,
) -> DataFrame:
    """(column, <operation>): one row per usable column; ``all`` gives six statistics side by side.

    Quantiles are exact unless ``accuracy`` asks for ``percentile_approx``. Numbers come out as
    BIGINT when every column is integral and the statistic keeps that, otherwise as DOUBLE; dates
    come out as timestamps and cannot be mixed with numbers in one call.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    name = canonical(operation)
    if name == "all":
        return stat_all(df, columns)
    if name == "mode":
        return stat_mode(df, columns)
    if name == "nunique":
        return stat_nunique(df, columns).withColumnRenamed("nunique", operation)
    if name == "percentile" and p is None:
        raise ValueError("percentile needs p")
    columns = usable(df, columns, name)
    if name in QUARTILES or name == "percentile":
        probability = p if name == "percentile" else QUARTILES[name]
        return quantile(df, columns, probability, operation, accuracy)
    kinds = {class_of(field_of(df, c).dataType) for c in columns}
    if name in OF_DATES and DATETIME in kinds and len(kinds) > 1:
        raise ValueError("dates and numbers need separate calls")

    def metric(frame: DataFrame, c: str) -> Column:
        a = aggregate(frame, c, name)
        if name in ("count", "nunique", "null_count") or DATETIME in kinds:
            return a
        whole = name in ("sum", "min", "max") and all(is_integral(field_of(df, c).dataType) for c in columns)
        return a.cast("bigint" if whole else "double")

    return column_report(df, columns, {operation: metric})


def quantile(
    df: DataFrame, columns: Sequence[str], p: float, name: str, accuracy: int | None = None,
) -> DataFrame:
    """(column, <name>): one quantile per column, NULL for a column without values."""
    kinds = {c: class_of(field_of(df, c).dataType) for c in columns}
    if len(set(kinds.values())) > 1:
        raise ValueError("dates and numbers need separate calls")
    if accuracy is not None:
        found = column_report(df, columns, {
            "quantile": lambda frame, c: F.percentile_approx(number(frame, c), F.lit(p), F.lit(accuracy))})
    else:
        listed = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
        found = df.sparkSession.range(1).select(listed).join(
            F.broadcast(exact_quantiles(df, columns, [p])), "column", "left")
    q = F.col("quantile")
    if DATETIME in kinds.values():
        q = from_micros(q, field_of(df, columns[0]).dataType)
    return found.select("column", q.alias(name))


def stat_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, min, max, median, count), all from one aggregate plus the medians."""
    columns = usable(df, columns, "std")
    rest = column_report(df, columns, {
        s: (lambda frame, c, s=s: aggregate(frame, c, s).cast("bigint" if s == "count" else "double"))
        for s in ALL if s != "median"
    })
    medians = quantile_columns(df, columns, {"median": 0.5})
    return rest.join(F.broadcast(medians), "column", "left").select("column", *ALL)


def quick_stats_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, p25, median, p75, max, null_count, null_pct, skewness, kurtosis)."""
    columns = usable(df, columns, "std")
    whole = ("count", "null_count")
    rest = column_report(df, columns, {
        s: (lambda frame, c, s=s: aggregate(frame, c, s).cast("bigint" if s in whole else "double"))
        for s in ("count", "mean", "std", "min", "max", "null_count", "null_pct", "skewness", "kurtosis")
    })
    quartiles = quantile_columns(df, columns, QUARTILES)
    return rest.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "median", "p75", "max",
        "null_count", "null_pct", "skewness", "kurtosis")


def quick_stats_categorical(df: DataFrame, column: str) -> DataFrame:
    """(column, unique, mode, null_count, null_pct, top_5): top_5 is an array of (value, count).

    The value counts carry the nulls as one more group, so one pass over the column gives all.
    """
    counts = df.groupBy(value(df, column).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    there = F.col("value").isNotNull()
    top = counts.filter(there).orderBy(F.desc("cnt"), "value").limit(5).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("rank"), "value"))).alias("top"))
    totals = counts.agg(
        F.count("value").alias("unique"),
        F.coalesce(F.sum(F.when(~there, F.col("cnt"))), F.lit(0).cast("long")).alias("null_count"),
        F.sum("cnt").alias("n"))
    best = top.select(F.transform("top", lambda t: F.struct(
        t.getField("value").alias("value"), (-t.getField("rank")).alias("count")))).scalar()
    return totals.withColumn("top_5", best).select(
        F.lit(column).alias("column"), "unique",
        F.try_element_at("top_5", F.lit(1)).getField("value").alias("mode"),
        "null_count", percent(F.col("null_count"), F.col("n")).alias("null_pct"), "top_5")


def value_counts(df: DataFrame, column: str, n: int | None = None, dropna: bool = True) -> DataFrame:
    """(column, count) by falling count, equal counts by value; the ``n`` first if given. The counts of a column named ``count``
    are called ``count_``."""
    v = value(df, column).alias("value")
    counts = (df.filter(value(df, column).isNotNull()) if dropna else df).groupBy(v).agg(
        F.count(F.lit(1)).alias("cnt"))
    ordered = counts.orderBy(F.desc("cnt"), F.col("value").asc_nulls_last())
    return (ordered if n is None else ordered.limit(n)).toDF(column, free("count", [column]))


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """(mode): the most frequent value, the least one on ties; one row, NULL without values.

    Counting by value first keeps every buffer small; the ``mode`` function would hold all
    distinct values of the column in one.
    """
    counts = df.filter(value(df, column).isNotNull()).groupBy(value(df, column).alias("value")).agg(
        F.count(F.lit(1)).alias("cnt"))
    return counts.agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))


def stat_mode(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """(column, mode): columns of one type; the mode keeps that type."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    wide = df.select(*[value(df, c).alias(c) for c in columns])
    listed = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    counts = wide.unpivot([], [raw(c) for c in columns], "column", "value").filter(
        F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    modes = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))
    return df.sparkSession.range(1).select(listed).join(F.broadcast(modes), "column", "left").select("column", "mode")


def stat_nunique(df: DataFrame, columns: Sequence[str], rsd: float | None = None) -> DataFrame:
    """(column, nunique): distinct non-null values, exact unless a relative deviation is given."""
    columns = list(columns)
    if rsd is not None:
        return column_report(df, columns, {"nunique": lambda frame, c: F.approx_count_distinct(
            groupable(value(frame, c), field_of(frame, c).dataType), rsd)})
    listed = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    found = df.sparkSession.range(1).select(listed).join(F.broadcast(distinct_counts(df, columns)), "column", "left")
    return found.select("column", F.coalesce("unique", F.lit(0).cast("bigint")).alias("nunique"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_count, null_pct)."""
    return column_report(df, list(columns or df.columns), {
        s: (lambda frame, c, s=s: aggregate(frame, c, s)) for s in ("null_count", "null_pct")})


def grouped_stat(
    df: DataFrame, columns: Sequence[str] | str, operation: str, by: str, *,
    p: float | None = None, accuracy: int | None = None,
) -> DataFrame:
    """(by, <operation>_<column>...): rows with a missing key are left out.

    Several columns stand side by side; all come from one aggregate, without a join. An unknown
    operation gives the seven statistics of :func:`grouped_all` for the first usable column. A result
    with the key's name gets an underscore.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    name = canonical(operation)
    if name == "all":
        return grouped_all(df, usable(df, columns, "std")[0], by)
    if name == "mode":
        raise ValueError("mode has no grouped form")
    if name == "percentile" and p is None:
        raise ValueError("percentile needs p")
    columns = usable(df, columns, name)
    if name in QUARTILES or name == "percentile":
        probability = p if name == "percentile" else QUARTILES[name]
        return grouped_quantile(df, columns, probability, operation, by, accuracy)
    df, (key,) = keyed(df, [by])
    return unkeyed(df.filter(raw(key).isNotNull()).groupBy(key).agg(
        *[aggregate(df, c, name).alias(f"{operation}_{c}") for c in columns]), [by])


def grouped_quantile(
    df: DataFrame, columns: Sequence[str], p: float, operation: str, by: str, accuracy: int | None = None,
) -> DataFrame:
    df, (key,) = keyed(df, [by])
    groups = df.filter(raw(key).isNotNull()).groupBy(key)
    if accuracy is not None:
        return unkeyed(groups.agg(*[
            F.percentile_approx(number(df, c), F.lit(p), F.lit(accuracy)).alias(f"{operation}_{c}") for c in columns]), [by])
    found = exact_quantiles(df, columns, [p], [key])
    side_by_side = found.groupBy(raw(key)).agg(*[
        F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(f"{operation}_{c}") for c in columns])
    dated = [raw(f"{operation}_{c}") if class_of(field_of(df, c).dataType) != DATETIME
             else from_micros(raw(f"{operation}_{c}"), field_of(df, c).dataType) for c in columns]
    # groups whose values are all missing have no quantile but keep their row
    return unkeyed(groups.agg(F.count(F.lit(1)).alias("__tg_rows")).join(side_by_side, key, "left").select(
        raw(key), *[d.alias(f"{operation}_{c}") for d, c in zip(dated, columns)]), [by])


def grouped_all(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, mean, sum, min, max, median, std, count); a statistic with the key's name gets an underscore."""
    column = usable(df, [column], "std")[0]
    df, (key,) = keyed(df, [by])
    rest = df.filter(raw(key).isNotNull()).groupBy(key).agg(
        *[aggregate(df, column, s).alias(s) for s in GROUPED_ALL if s != "median"])
    medians = quantile_columns(df, [column], {"median": 0.5}, [key]).drop("column", "n")
    return unkeyed(rest.join(medians, key, "left").select(raw(key), *GROUPED_ALL), [by])
