"""The tables behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableglass.functions.columns import (
    CATEGORICAL, DATETIME, NUMERIC, class_of, columns_of, field_of, number, numeric_columns, raw, value,
)
from tableglass.operators.correlate import corr_heatmap
from tableglass.operators.quality import fences
from tableglass.operators.rows import head, ordering, sample_rows
from tableglass.operators.stats import aggregate, value_counts
from tableglass.plans.joins import lookup
from tableglass.plans.names import free, keyed, unkeyed
from tableglass.plans.quantiles import few_groups
from tableglass.plans.reports import scalars

# Defaults of the charts.
HISTOGRAM_BINS = 30
FREQUENCIES = 30
TOP_SUMS = 20
TOP_COUNTS = 20
FIRST_ROWS = 50
SCATTER_SAMPLE = 5000
LINE_POINTS = 1000
PIE_SLICES = 10
DENSITY_GRID = 100
DENSITY_BINS = 512


def first_numeric(df: DataFrame, column: str | None) -> str:
    """The column itself if numeric, otherwise the table's first numeric column."""
    if column is not None and class_of(field_of(df, column).dataType) == NUMERIC:
        return column
    numbers = numeric_columns(df)
    if not numbers:
        raise ValueError("the table has no numeric column")
    return numbers[0]


# -- histograms and frequencies ---------------------------------------------------------------

def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 1..bins of equal width over [lo, hi], the last one closed; 1 when lo equals hi."""
    place = F.floor((x - lo) / (hi - lo) * F.lit(float(bins))) + 1
    return F.when(hi > lo, F.least(place, F.lit(bins))).otherwise(F.lit(1)).cast("int")


def binned(df: DataFrame, column: str, color: str | None, nbins: int) -> tuple[DataFrame, Column]:
    x = number(df, column)
    edges = scalars(df, lo=F.min(x), hi=F.max(x))
    keys = [value(df, color).alias(color)] if color else []
    counted = df.filter(x.isNotNull()).groupBy(
        *keys, bin_of(x, edges.getField("lo"), edges.getField("hi"), nbins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    return counted, edges


def hist_numeric(df: DataFrame, column: str, nbins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, lower, upper, count): every bin, the empty ones too; one bin for a constant column."""
    counted, edges = binned(df, column, None, nbins)
    x = number(df, column)
    lo, hi = F.col("lo"), F.col("hi")
    bins = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).filter(lo.isNotNull()).select(
        "lo", "hi", F.explode(F.sequence(F.lit(1), F.when(hi > lo, F.lit(nbins)).otherwise(F.lit(1)))).alias("bin"))
    return bins.join(F.broadcast(counted), "bin", "left").select(
        "bin", *bin_edges(lo, hi, F.col("bin"), nbins), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def bin_edges(lo: Column, hi: Column, place: Column, nbins: int) -> list[Column]:
    step = (hi - lo) / F.lit(float(nbins))
    return [(lo + step * (place - 1)).alias("lower"),
            F.when(place == nbins, hi).otherwise(lo + step * place).alias("upper")]


def hist_by(df: DataFrame, column: str, color: str, nbins: int = HISTOGRAM_BINS) -> DataFrame:
    """(color, bin, lower, upper, count): the bins in use, with edges common to all colours. A column with the colour's name gets
    an underscore."""
    df, (key,) = keyed(df, [color])
    counted, edges = binned(df, column, key, nbins)
    lo, hi = edges.getField("lo"), edges.getField("hi")
    return unkeyed(counted.filter(raw(key).isNotNull()).select(
        raw(key), "bin", *bin_edges(lo, hi, F.col("bin"), nbins), "count"), [color])


def hist_marginal_box(df: DataFrame, column: str, color: str | None = None) -> DataFrame:
    """The box drawn above a histogram."""
    return box_summary(df, column, color=color)


def freq_top(df: DataFrame, column: str, n: int = FREQUENCIES) -> DataFrame:
    """(column, count) of the n most frequent values."""
    return value_counts(df, column, n)


# -- bars -------------------------------------------------------------------------------------

def bar_sum(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """(x, [color,] y): the sum of y per x and colour; rows with a missing key are left out."""
    keys = [x] if color in (None, x) else [x, color]
    df, names = keyed(df, keys)
    return unkeyed(df.dropna(subset=names).groupBy(*names).agg(aggregate(df, y, "sum").alias(y)), keys)


def bar_sum_top(df: DataFrame, y: str, by: str, n: int = TOP_SUMS) -> DataFrame:
    """(by, y): the n groups with the largest sums."""
    y = first_numeric(df, y)
    return bar_sum(df, by, y).orderBy(raw(free(y, [by])).desc(), raw(by)).limit(n)


def bar_count_top(df: DataFrame, x: str, n: int = TOP_COUNTS) -> DataFrame:
    """(x, count) of the n most frequent values."""
    return value_counts(df, x, n)


def bar_first_rows(df: DataFrame, y: str, order_by: Sequence[str] | str, n: int = FIRST_ROWS) -> DataFrame:
    """(position, y): the raw values of the first n rows; positions count from 0."""
    first = head(df, order_by, n)
    place = F.row_number().over(Window.orderBy(*ordering(order_by))) - 1
    return first.select(place.alias("position"), value(df, y).alias(y))


# -- points -----------------------------------------------------------------------------------

def point_columns(df: DataFrame, x: str | None, y: str | None) -> tuple[str, str]:
    """The named columns if both are numeric, otherwise the table's first two numeric columns."""
    numbers = numeric_columns(df)
    if x in numbers and y in numbers:
        return x, y
    if len(numbers) < 2:
        raise ValueError("points need two numeric columns")
    return numbers[0], numbers[1]


def scatter_points(
    df: DataFrame, x: str | None = None, y: str | None = None, color: str | None = None,
) -> DataFrame:
    """The columns to draw, without the rows that lack x or y."""
    x, y = point_columns(df, x, y)
    names = list(dict.fromkeys([x, y, *([color] if color else [])]))
    return df.select(*[value(df, c).alias(c) for c in names]).dropna(subset=list({x, y}))


def scatter_sample(
    df: DataFrame, x: str, y: str, color: str | None = None, n: int = SCATTER_SAMPLE, seed: int = 42,
    key: Sequence[str] | str | None = None,
) -> DataFrame:
    """At most n rows, chosen by hash of the key, in the columns to draw."""
    names = list(dict.fromkeys([x, y, *([color] if color else [])]))
    return sample_rows(df, n, seed, key or names).select(*[value(df, c).alias(c) for c in names])


# -- lines and areas --------------------------------------------------------------------------

def line_mean_by(df: DataFrame, y: str, by: str) -> DataFrame:
    """(by, y): the mean per group, in order of the group."""
    y = first_numeric(df, y)
    df, (key,) = keyed(df, [by])
    means = df.filter(raw(key).isNotNull()).groupBy(key).agg(F.avg(number(df, y)).alias(y if y != by else f"mean_{y}"))
    return unkeyed(means.orderBy(raw(key)), [by])


def line_raw(
    df: DataFrame, y: str, x: str | None = None, color: str | None = None, order_by: Sequence[str] | str | None = None,
) -> DataFrame:
    """The rows to draw, sorted by x when x is a date, otherwise in the order named."""
    names = list(dict.fromkeys([c for c in (x, y, color) if c]))
    if x is not None and class_of(field_of(df, x).dataType) == DATETIME:
        ordered = df.orderBy(*ordering([x, *([order_by] if isinstance(order_by, str) else order_by or [])]))
    elif order_by:
        ordered = df.orderBy(*ordering(order_by))
    else:
        raise ValueError("without a date to sort by, name the order of the rows")
    return ordered.select(*[value(df, c).alias(c) for c in names])


def line_points(df: DataFrame, x: str, y: str, color: str | None = None, max_points: int = LINE_POINTS) -> DataFrame:
    """The points that draw the same line as all rows on ``max_points`` columns of pixels: in each column, of each colour, the first and
    last point and the lowest and highest. At most four a column; rows without x or y are left out.

    x has to be a number or a date. Points are compared by x, then y (first and last) or by y, then x (lowest and highest), so ties
    take the smaller, for last and highest the larger. One aggregate with map-side combining; only columns of pixels are shuffled.
    """
    keys = [color] if color and color not in (x, y) else []
    named, names = keyed(df, keys)
    place, height = number(df, x), number(df, y)
    edges = scalars(df.filter(height.isNotNull()), lo=F.min(place), hi=F.max(place))
    own = F.struct(value(df, x).alias("x"), value(df, y).alias("y"))
    points = named.filter(place.isNotNull() & height.isNotNull()).select(
        *[raw(n) for n in names], bin_of(place, edges.getField("lo"), edges.getField("hi"), max_points).alias("bin"),
        F.struct(place.alias("a"), height.alias("b"), own.alias("p")).alias("across"), F.struct(height.alias("a"), place.alias("b"), own.alias("p")).alias("up"))
    ends = points.groupBy(*names, "bin").agg(
        F.min("across").alias("first"), F.max("across").alias("last"), F.min("up").alias("low"), F.max("up").alias("high"))
    four = F.array_distinct(F.array(*[F.col(f"{c}.p") for c in ("first", "last", "low", "high")]))
    drawn = ends.select(*names, F.inline(four))
    shown = drawn.select(raw("x").alias(x), *([raw("y").alias(y)] if y != x else []), *[raw(n).alias(k) for n, k in zip(names, keys)])
    return shown.orderBy(raw(x), *([raw(y)] if y != x else []))


def line_auto(
    df: DataFrame, x: str, y: str, color: str | None = None, aggregate: bool = True,
    order_by: Sequence[str] | str | None = None, max_points: int | None = LINE_POINTS,
) -> DataFrame:
    """The mean of y per x, whatever the colour, or with ``aggregate=False`` the rows: the points that draw the same line on ``max_points``
    columns of pixels, or all rows with ``max_points=None``, or where x is neither a number nor a date. The result's columns
    don't depend on how many rows there are."""
    if aggregate:
        return line_mean_by(df, y, x)
    if max_points is None or class_of(field_of(df, x).dataType) not in (NUMERIC, DATETIME):
        return line_raw(df, y, x, color, order_by or x)
    return line_points(df, x, y, color, max_points)


def area_series(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """(x, [color,] y, top): the sum of y per x and colour, and the height it is stacked up to."""
    sums = bar_sum(df, x, y, color)
    y, top = sums.columns[-1], free("top", sums.columns)
    if color in (None, x):
        return sums.withColumn(top, raw(y)).orderBy(raw(x))
    stack = Window.partitionBy(raw(x)).orderBy(raw(color)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn(top, F.sum(raw(y)).over(stack)).orderBy(raw(x), raw(color))


# -- shares -----------------------------------------------------------------------------------

def pie_share(df: DataFrame, column: str, n: int = PIE_SLICES) -> DataFrame:
    """(column, count, share): the n most frequent values; shares are of the slices kept."""
    kept = value_counts(df, column, n)
    count = kept.columns[1]
    return kept.withColumn(free("share", kept.columns), raw(count) / F.sum(raw(count)).over(Window.partitionBy()))


# -- boxes and densities ----------------------------------------------------------------------

def box_keys(x: str | None, color: str | None) -> list[str]:
    return list(dict.fromkeys([c for c in (x, color) if c]))


def with_fences(df: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    """(by..., y, fences...): every value next to the box of its group."""
    boxes = fences(df, [y], by).drop("column")
    values = df.select(*[value(df, b).alias(b) for b in by], number(df, y).alias("y")).dropna()
    if not by:
        # one row, read as a scalar
        names = [c for c in boxes.columns if c != "n"]
        b = boxes.agg(F.struct(*[F.max(n).alias(n) for n in names]).alias("box")).scalar()
        return values.select("y", *[b.getField(n).alias(n) for n in names])
    return lookup(values, boxes, by, few_groups(df, by)).drop("n")


def inside_fences() -> Column:
    return F.col("y").between(F.col("lower"), F.col("upper"))


def box_summary(df: DataFrame, y: str, x: str | None = None, color: str | None = None) -> DataFrame:
    """([x, color,] q1, median, q3, whisker_low, whisker_high, n, outliers); whiskers reach the
    furthest values within 1.5 IQR of the quartiles."""
    by = box_keys(x, color)
    df, names = keyed(df, by)
    marked = with_fences(df, y, names)
    return unkeyed(marked.groupBy(*names).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside_fences(), F.col("y"))).alias("whisker_low"),
        F.max(F.when(inside_fences(), F.col("y"))).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"), F.count_if(~inside_fences()).alias("outliers")), by)


def box_outlier_points(df: DataFrame, y: str, x: str | None = None, color: str | None = None) -> DataFrame:
    """([x, color,] y): the values beyond the fences."""
    by = box_keys(x, color)
    df, names = keyed(df, by)
    return unkeyed(with_fences(df, y, names).filter(~inside_fences()).select(*names, F.col("y").alias(y)), by)


def violin_density(
    df: DataFrame, y: str, x: str | None = None, color: str | None = None, grid: int = DENSITY_GRID, bins: int = DENSITY_BINS,
) -> DataFrame:
    """([x, color,] point, at, density): a Gaussian kernel density per group on ``grid`` points.

    The bandwidth is 0.9 min(std, IQR / 1.34) n^(-1/5), the grid spans two bandwidths beyond the
    extremes. Values are first counted in ``bins`` equal bins of their group and each bin stands at
    its centre, so the kernel sums run over at most bins x grid rows per group. A group without
    spread (one row, or equal values) has one point at its value, with no density.
    """
    by = box_keys(x, color)
    df, keys = keyed(df, by)
    values = df.select(*keys, number(df, y).alias("y")).dropna()
    shape = values.groupBy(*keys).agg(
        F.min("y").alias("lo"), F.max("y").alias("hi"), F.stddev_samp("y").alias("std"),
        F.count(F.lit(1)).cast("double").alias("n"))
    quartiles = fences(df, [y], keys)
    if by:
        shape = shape.join(quartiles.select(*keys, "iqr"), keys)
    else:
        shape = shape.withColumn("iqr", quartiles.select("iqr").scalar())
    spread = F.when(F.col("iqr") > 0, F.least(F.col("std"), F.col("iqr") / 1.34)).otherwise(F.col("std"))
    shape = shape.withColumn("h", F.lit(0.9) * spread * F.pow("n", F.lit(-0.2))).drop("std", "iqr")
    wide = (F.col("hi") > F.col("lo")) & (F.col("h") > 0)
    flat = shape.filter(F.coalesce(~wide, F.lit(True)) & (F.col("n") > 0)).select(
        *keys, F.lit(0).alias("point"), F.col("lo").alias("at"), F.lit(None).cast("double").alias("density"))
    shape = shape.filter(wide)
    if by:
        placed = lookup(values, shape, keys, few_groups(df, keys))
    else:
        s = shape.agg(F.struct(*[F.max(c).alias(c) for c in ("lo", "hi", "n", "h")]).alias("s")).scalar()
        placed = values.select("y", *[s.getField(c).alias(c) for c in ("lo", "hi", "n", "h")])
    centres = placed.filter(F.col("h").isNotNull()).groupBy(
        *keys, "lo", "hi", "n", "h", bin_of(F.col("y"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt")).withColumn(
        "centre", F.col("lo") + (F.col("bin") - 0.5) * (F.col("hi") - F.col("lo")) / float(bins))
    start, end = F.col("lo") - 2.0 * F.col("h"), F.col("hi") + 2.0 * F.col("h")
    points = centres.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "at", start + F.col("point") * (end - start) / float(grid - 1))
    z = (F.col("at") - F.col("centre")) / F.col("h")
    kernel = F.col("cnt") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * 2.5066282746310002)
    return unkeyed(points.groupBy(*keys, "point", "at").agg(F.sum(kernel).alias("density")).unionByName(flat), by)


# -- dispatch ---------------------------------------------------------------------------------

def chart_data(
    df: DataFrame, chart: str, x: str | None = None, y: str | None = None, color: str | None = None, **options,
) -> DataFrame:
    """The table for a chart by name, with the default columns the chart would take.

    x defaults to the first text column for bars and pies, otherwise to the first numeric column;
    y to the first numeric column where a chart needs one.
    """
    numbers, texts = numeric_columns(df), columns_of(df, CATEGORICAL)
    if x is None:
        candidates = (texts if chart in ("bar", "pie") else []) or numbers or df.columns
        x = candidates[0]
    if y is None and chart in ("scatter", "line", "bar"):
        y = numbers[0] if numbers else None
    is_number = class_of(field_of(df, x).dataType) == NUMERIC
    if chart == "histogram":
        if not is_number:
            return freq_top(df, x, **options)
        return hist_by(df, x, color, **options) if color else hist_numeric(df, x, **options)
    if chart == "bar":
        return bar_sum(df, x, y, color) if y else bar_count_top(df, x, **options)
    if chart == "scatter":
        return scatter_sample(df, x, y, color, **options)
    if chart == "line":
        return line_auto(df, x, y, color, **options)
    if chart == "pie":
        return pie_share(df, x, **options)
    if chart == "box":
        return box_summary(df, y, x, color) if y else box_summary(df, x)
    if chart == "heatmap":
        return corr_heatmap(df, **options)
    if chart == "area":
        return area_series(df, x, y or first_numeric(df, None), color)
    if chart == "violin":
        return violin_density(df, y, x, color, **options) if y else violin_density(df, x, None, color, **options)
    raise ValueError(f"unknown chart {chart!r}")
