"""Missing values, duplicates, outliers and data-quality rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.functions.columns import (
    CATEGORICAL, DATETIME, NUMERIC, clean, columns_of, field_of, groupable, number, numeric_columns,
    percent, raw, value,
)
from tableglass.functions.moments import sample_skewness
from tableglass.operators.profile import kind, missing, of_class, rows
from tableglass.plans.distinct import distinct_metric
from tableglass.plans.names import free
from tableglass.plans.quantiles import quantile_columns
from tableglass.plans.repeats import split_repeats
from tableglass.plans.reports import column_report, scalars

# Thresholds of the reports.
DROP_ABOVE_PCT = 50.0
SKEWED_ABOVE = 1.0
FENCE = 1.5
LEAST_FOR_OUTLIERS = 10
Z_LIMIT = 3.0
ISSUES = ("missing", "duplicates", "outliers")


# -- missing values ---------------------------------------------------------------------------

def missing_report(df: DataFrame) -> DataFrame:
    """(column, class, missing, pct, total_missing, columns_affected) where anything is missing,
    most first. Booleans count as categories: they are filled with their mode."""
    report = column_report(df, df.columns, {"missing": missing, "rows": rows})
    some = F.col("missing") > 0
    classes = F.when(F.col("column").isin(columns_of(df, DATETIME)), "datetime").when(
        F.col("column").isin(columns_of(df, NUMERIC)), "numeric").otherwise(
        "categorical")
    totals = report.agg(F.struct(
        F.sum("missing").alias("total"), F.count_if(some).alias("columns")).alias("t")).scalar()
    return report.filter(some).select(
        "column", classes.alias("class"), "missing",
        F.round(percent(F.col("missing"), F.col("rows")), 2).alias("pct"),
        totals.getField("total").alias("total_missing"), totals.getField("columns").alias("columns_affected"),
    ).orderBy(F.desc("missing"), "column")


def missing_recommendations(df: DataFrame) -> DataFrame:
    """(column, missing, strategy): drop_column, fill_median, fill_mean or fill_mode."""
    report = column_report(df, df.columns, {
        "missing": missing, "rows": rows,
        "skewness": of_class([NUMERIC], lambda frame, c: sample_skewness(number(frame, c)), "double"),
    })
    numbers = columns_of(df, NUMERIC)
    strategy = (
        F.when(percent(F.col("missing"), F.col("rows")) > DROP_ABOVE_PCT, "drop_column")
        .when(F.col("column").isin(numbers) & (F.abs("skewness") > SKEWED_ABOVE), "fill_median")
        .when(F.col("column").isin(numbers), "fill_mean")
        .otherwise("fill_mode"))
    return report.filter(F.col("missing") > 0).select("column", "missing", strategy.alias("strategy"))


# -- duplicates -------------------------------------------------------------------------------

COPIES = "__tg_copies"


def whole_rows(df: DataFrame) -> list[Column]:
    """Every column in comparable form: NULL equals NULL, NaN is NULL, maps by their entries."""
    return [groupable(value(df, c), field_of(df, c).dataType).alias(c) for c in df.columns]


def row_groups(df: DataFrame) -> DataFrame:
    """(columns..., COPIES): one row per distinct row; copies meet already on the map side. Unique rows of a wide table are not
    shuffled."""
    alone, others = split_repeats(df, whole_rows(df))
    groups = others.groupBy(*whole_rows(others)).agg(F.count(F.lit(1)).alias(COPIES))
    if alone is None:
        return groups
    return groups.unionByName(alone.select(*whole_rows(alone), F.lit(1).cast("bigint").alias(COPIES)))


def repeated_groups(df: DataFrame) -> DataFrame:
    """Those of the row groups that have more than one copy; unique rows of a wide table are not looked at again."""
    _, others = split_repeats(df, whole_rows(df))
    return others.groupBy(*whole_rows(others)).agg(F.count(F.lit(1)).alias(COPIES)).filter(F.col(COPIES) > 1)


def duplicate_count(df: DataFrame) -> DataFrame:
    """(rows, duplicates, pct): rows beyond the first of each group of identical rows."""
    n, extra = F.coalesce(F.sum(COPIES), F.lit(0).cast("long")), F.sum(F.col(COPIES) - 1)
    return row_groups(df).agg(n.alias("rows"), F.coalesce(extra, F.lit(0).cast("long")).alias("duplicates")).select(
        "rows", "duplicates", F.round(percent(F.col("duplicates"), F.col("rows")), 2).alias("pct"))


def duplicate_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows, in order of all columns, of those that have an identical other row."""
    keys = [raw(c).asc_nulls_last() for c in df.columns]
    groups = repeated_groups(df).orderBy(*keys).limit(n)
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col(COPIES), F.lit(n)).cast("int"))).alias("__tg_copy")
    return groups.select(*[raw(c) for c in df.columns], copies).orderBy(*keys).limit(n).drop("__tg_copy")


def key_candidate_duplicates(df: DataFrame) -> DataFrame:
    """(columns, duplicates): repeats of the first 1, 2 and 3 columns taken as a key."""
    prefixes = [df.columns[:i] for i in range(1, min(4, len(df.columns)))]
    repeats = [
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*[
            groupable(value(df, c), field_of(df, c).dataType).alias(c) for c in p]))).alias(f"d{i}")
        for i, p in enumerate(prefixes)
    ]
    if not prefixes:
        return df.sparkSession.createDataFrame([], "columns array<string>, duplicates bigint")
    lines = [
        F.struct(F.array(*[F.lit(c) for c in p]).alias("columns"), F.col(f"d{i}").alias("duplicates"))
        for i, p in enumerate(prefixes)
    ]
    return df.agg(*repeats).select(F.inline(F.array(*lines))).filter(F.col("duplicates") > 0)


# -- outliers ---------------------------------------------------------------------------------

def fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, q1, median, q3, iqr, lower, upper)."""
    q = quantile_columns(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    iqr = F.col("q3") - F.col("q1")
    return q.select("*", iqr.alias("iqr"), (F.col("q1") - FENCE * iqr).alias("lower"),
                    (F.col("q3") + FENCE * iqr).alias("upper"))


def fence_scalars(df: DataFrame, columns: Sequence[str]) -> Column:
    """The fences as one scalar struct: lower0, upper0, q1_0 ... by position of the column."""
    f = fences(df, columns)
    named = [
        F.max(F.when(F.col("column") == c, F.col(b))).alias(f"{b}{i}")
        for i, c in enumerate(columns) for b in ("q1", "q3", "iqr", "lower", "upper")
    ]
    return f.agg(F.struct(*named).alias("fences")).scalar()


def outside(x: Column, bounds: Column, i: int = 0) -> Column:
    return (x < bounds.getField(f"lower{i}")) | (x > bounds.getField(f"upper{i}"))


def outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    """(column, lower, upper, outliers, pct, q1, q3, iqr): values beyond 1.5 IQR of the quartiles;
    the percentage is of all rows."""
    b = fence_scalars(df, [column])
    x = number(df, column)
    counted = df.agg(F.count_if(outside(x, b)).alias("outliers"), F.count(F.lit(1)).alias("rows"))
    bound = {name: b.getField(f"{name}0").alias(name) for name in ("lower", "upper", "q1", "q3", "iqr")}
    return counted.select(F.lit(column).alias("column"), bound["lower"], bound["upper"], "outliers",
                          percent(F.col("outliers"), F.col("rows")).alias("pct"),
                          bound["q1"], bound["q3"], bound["iqr"])


def outlier_facts(df: DataFrame) -> DataFrame:
    """(column, values, rows, outliers, lower, upper, min, max, lowest, highest) per numeric column."""
    columns = numeric_columns(df)
    if not columns:
        raise ValueError("the table has no numeric column")
    b = fence_scalars(df, columns)
    at = {c: i for i, c in enumerate(columns)}

    def marked(frame: DataFrame, c: str) -> Column:
        return F.when(outside(number(frame, c), b, at[c]), number(frame, c))
    return column_report(df, columns, {
        "values": lambda frame, c: F.count(number(frame, c)), "rows": rows,
        "outliers": lambda frame, c: F.count(marked(frame, c)),
        "lower": lambda frame, c: F.max(b.getField(f"lower{at[c]}")),
        "upper": lambda frame, c: F.max(b.getField(f"upper{at[c]}")),
        "min": lambda frame, c: F.min(number(frame, c)), "max": lambda frame, c: F.max(number(frame, c)),
        "lowest": lambda frame, c: F.min(marked(frame, c)), "highest": lambda frame, c: F.max(marked(frame, c)),
    }).filter((F.col("values") >= LEAST_FOR_OUTLIERS) & (F.col("outliers") > 0))


def outliers_iqr_all(df: DataFrame) -> DataFrame:
    """(column, outliers, pct, lower, upper) of numeric columns with ten values and an outlier."""
    return outlier_facts(df).select(
        "column", "outliers", F.round(percent(F.col("outliers"), F.col("rows")), 2).alias("pct"),
        F.round("lower", 2).alias("lower"), F.round("upper", 2).alias("upper"))


def outlier_extremes(df: DataFrame) -> DataFrame:
    """(column, min, max, suspected_low, suspected_high) for the columns of :func:`outliers_iqr_all`."""
    return outlier_facts(df).select("column", "min", "max", F.col("lowest").alias("suspected_low"),
                                    F.col("highest").alias("suspected_high"))


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value lies outside the fences."""
    return df.filter(outside(number(df, column), fence_scalars(df, [column])))


def outliers_zscore(df: DataFrame, column: str, threshold: float = Z_LIMIT) -> DataFrame:
    """The rows further than ``threshold`` sample deviations from the mean, with their ``zscore`` (``zscore_`` in a table that has
    such a column)."""
    x = number(df, column)
    m = scalars(df, mean=F.avg(x), std=F.stddev_samp(x))
    z = F.abs(F.try_divide(x - m.getField("mean"), m.getField("std")))
    return df.select("*", z.alias(free("zscore", df.columns))).filter(z > threshold)


# -- summaries --------------------------------------------------------------------------------

def quality_summary(df: DataFrame, issue_type: str = "all") -> DataFrame:
    """(issue, metric, value): the counts behind the missing, duplicate and outlier reports.

    ``table`` rows give the size; ``issues_found`` counts the kinds of issue present.
    """
    if issue_type not in (*ISSUES, "all"):
        raise ValueError(f"unknown issue type {issue_type!r}; use one of {[*ISSUES, 'all']}")
    wanted = ISSUES if issue_type == "all" else (issue_type,)
    parts = []
    if "missing" in wanted:
        per_column = column_report(df, df.columns, {"missing": missing}).filter(F.col("missing") > 0)
        parts.append(measures(per_column, "missing", {
            "total_missing": F.coalesce(F.sum("missing"), F.lit(0)), "columns_affected": F.count(F.lit(1))}))
    if "duplicates" in wanted:
        parts.append(measures(duplicate_count(df), "duplicates", {
            "total_duplicates": F.max("duplicates"), "percentage": F.max("pct")}))
    if "outliers" in wanted and numeric_columns(df):
        parts.append(measures(outlier_facts(df), "outliers", {
            "columns_analyzed": F.lit(len(numeric_columns(df))),
            "columns_with_outliers": F.count(F.lit(1)),
            "total_outliers": F.coalesce(F.sum("outliers"), F.lit(0))}))
    size = measures(df, "table", {"rows": F.count(F.lit(1)), "columns": F.lit(len(df.columns))})
    whole = size
    for part in parts:
        whole = whole.unionAll(part)
    first = F.col("metric").isin("total_missing", "total_duplicates", "total_outliers")
    found = whole.agg(F.count_if(first & (F.col("value") > 0)).cast("double").alias("value"))
    return whole.unionAll(found.select(F.lit("table").alias("issue"), F.lit("issues_found").alias("metric"), "value"))


def measures(df: DataFrame, issue: str, aggregates: dict[str, Column]) -> DataFrame:
    row = df.agg(*[a.cast("double").alias(n) for n, a in aggregates.items()])
    lines = [F.struct(F.lit(issue).alias("issue"), F.lit(n).alias("metric"), F.col(n).alias("value"))
             for n in aggregates]
    return row.select(F.inline(F.array(*lines)))


def quality_rules(
    df: DataFrame, columns: Sequence[str] = (), by: str | None = None, duplicates: bool = True,
) -> DataFrame:
    """(code, level, column, measure): the rules the data breaks.

    ``columns`` are the columns to be analysed, ``by`` the intended group key. Rules about the
    whole table carry the column ``*``. Percentages and counts are the measures.
    """
    table = clean(df)
    looked_at = list(dict.fromkeys([*columns, *([by] if by else [])]))
    total_null = sum((missing(table, c) for c in df.columns), F.lit(0).cast("long"))
    numbers = [F.count(F.lit(1)).alias("rows"), total_null.alias("nulls")]
    unique = distinct_metric(table, looked_at) if looked_at else None
    for i, c in enumerate(looked_at):
        numbers += [missing(table, c).alias(f"null{i}"), unique(table, c).alias(f"unique{i}")]
    facts = table.agg(*numbers)
    if duplicates:
        facts = facts.withColumn(COPIES, duplicate_count(df).select("duplicates").scalar())

    n = F.col("rows")
    rules: list[tuple[str, str, str, Column, Column]] = [
        ("EMPTY_TABLE", "error", "*", n == 0, n),
        ("NO_MISSING", "info", "*", F.col("nulls") == 0, F.col("nulls")),
    ]
    if numeric_columns(df):
        rules.append(("TOO_SMALL_FOR_OUTLIERS", "warning", "*", n < LEAST_FOR_OUTLIERS, n))
    if duplicates:
        copies = F.col(COPIES)
        rules += [
            ("NO_DUPLICATES", "info", "*", copies == 0, copies),
            ("TOO_MANY_DUPLICATES", "warning", "*", copies > n * 0.5, percent(copies, n)),
        ]
    for c in columns:
        i = looked_at.index(c)
        unique, nulls = F.col(f"unique{i}"), percent(F.col(f"null{i}"), n)
        rules.append(("TOO_MANY_MISSING", "warning", c, nulls > DROP_ABOVE_PCT, nulls))
        if kind(df, c) == NUMERIC:
            rules.append(("CONSTANT_COLUMN", "warning", c, unique == 1, unique))
        if kind(df, c) == CATEGORICAL:
            rules += [
                ("TOO_MANY_CATEGORIES_HISTOGRAM", "warning", c, unique > 50, unique),
                ("TOO_MANY_PIE_SLICES", "warning", c, unique > 10, unique),
                ("CHAOTIC_LINE", "warning", c, unique > 100, unique),
            ]
    if by:
        i = looked_at.index(by)
        unique, nulls = F.col(f"unique{i}"), percent(F.col(f"null{i}"), n)
        if kind(df, by) == NUMERIC:
            rules.append(("DENSE_NUMERIC_GROUPS", "warning", by, unique > 1000, unique))
        rules += [
            ("TOO_MANY_GROUPS", "warning", by, unique > 1000, unique),
            ("SINGLE_GROUP", "info", by, unique == 1, unique),
            ("MISSING_GROUP_KEYS", "warning", by, nulls > 0, nulls),
        ]
    broken = [
        F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"),
                                   F.lit(column).alias("column"), measure.cast("double").alias("measure")))
        for code, level, column, condition, measure in rules
    ]
    return facts.select(F.inline(F.array_compact(F.array(*broken))))
