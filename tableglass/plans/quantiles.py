"""Exact quantiles of a column of any size, overall or per group.

The built-in exact ``percentile`` keeps one value-to-count map per group in one buffer, which a
near-unique column of a large table outgrows. It is used only where the table was found to have no
more than a set number of rows; beyond that the answer is found by counting:

1. every value falls into a bucket of relative width 2^(1/1024) (sign and log2), and one
   map-side-combined aggregate counts the buckets; running counts tell which bucket holds each
   wanted position;
2. only the values of those buckets are counted again, in 65,536 equal slices of the bucket;
3. only the values of the slices wanted are counted one by one.

A bucket or slice whose least and greatest values agree is already the answer, and when all are,
the later passes have nothing to look up and adaptive execution drops them. No raw row is
shuffled except in the last pass; no group, however hot, meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.functions.columns import number, quoted, raw, value
from tableglass.plans.joins import HOT_ROWS

STEPS_PER_OCTAVE = 1024.0
SMALLEST_EXPONENT = 1100.0  # every finite double has log2 > -1075
SLICES = 65536.0
BROADCAST_GROUPS = 100_000
BUFFER_ROWS = 2**18


def log_bucket(v: Column) -> Column:
    """A whole number (as DOUBLE) that never decreases as ``v`` grows."""
    step = F.floor(F.log2(F.abs(v)) * STEPS_PER_OCTAVE).cast("double")
    return F.when(v == 0.0, F.lit(0.0)).otherwise(
        F.signum(v) * (step + STEPS_PER_OCTAVE * SMALLEST_EXPONENT))


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by0..., column, value): the non-null values of the columns, one per row, as DOUBLE.

    Rows with a missing group key are left out.
    """
    wide = df.select(*[value(df, b).alias(f"by{i}") for i, b in enumerate(by)],
                     *[number(df, c).alias(c) for c in columns])
    keys = [f"by{i}" for i in range(len(by))]
    if keys:
        wide = wide.dropna(subset=keys)
    if len(columns) == 1:
        long = wide.select(*keys, F.lit(columns[0]).alias("column"), raw(columns[0]).alias("value"))
    else:
        long = wide.unpivot(keys, [quoted(c) for c in columns], "column", "value")
    return long.filter(F.col("value").isNotNull()).select(*keys, "column", "value")


def few_groups(df: DataFrame, by: Sequence[str], rows_each: int = 1) -> bool:
    """Whether all groups together have at most BROADCAST_GROUPS rows, of which each has ``rows_each``: one scan of the key
    columns alone."""
    if not by:
        return rows_each <= BROADCAST_GROUPS
    found = df.agg(F.approx_count_distinct(F.struct(*[raw(b) for b in by])).alias("n")).first()["n"]
    return found * rows_each <= BROADCAST_GROUPS


# One statement for the three passes: buckets, slices of the open buckets, values of the open slices.
# {keys} are the group columns and ``column``.
PASSES = """
WITH counted AS (
  SELECT {keys}, bucket, count(1) AS cnt, min(value) AS lo, max(value) AS hi
  FROM {{facts}} GROUP BY {keys}, bucket
), placed AS (
  SELECT *, sum(cnt) OVER (PARTITION BY {keys}) AS n,
    sum(cnt) OVER (PARTITION BY {keys} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto
  FROM counted
), wanted AS (
  SELECT *, explode({probs}) AS p FROM placed
), sided AS (
  SELECT *, inline(array(
    named_struct('side', 0, 'position', floor((n - 1) * p)), named_struct('side', 1, 'position', ceil((n - 1) * p))))
  FROM wanted
), first_pass AS (
  SELECT {keys}, p, side, n, bucket, position - upto + cnt AS within, lo, hi, cnt AS rows
  FROM sided WHERE position >= upto - cnt AND position < upto
), open_buckets AS (
  SELECT DISTINCT {keys}, bucket, lo, hi, rows FROM first_pass WHERE lo < hi
), in_buckets AS (
  {in_open_buckets}
), slices AS (
  SELECT {keys}, bucket, {slice} AS slice, count(1) AS cnt, min(value) AS slo, max(value) AS shi
  FROM in_buckets GROUP BY ALL
), placed_slices AS (
  SELECT *, sum(cnt) OVER (PARTITION BY {keys}, bucket ORDER BY slice ROWS UNBOUNDED PRECEDING) AS upto FROM slices
), second_pass AS (
  SELECT {t_keys}, t.p, t.side, t.n, t.bucket, s.slice, t.within - s.upto + s.cnt AS within, s.slo, s.shi,
    s.cnt AS rows
  FROM first_pass t JOIN placed_slices s ON {same_ts}
  WHERE t.lo < t.hi AND t.within >= s.upto - s.cnt AND t.within < s.upto
), open_slices AS (
  SELECT DISTINCT {keys}, bucket, slice, slo, shi, rows FROM second_pass WHERE slo < shi
), in_slices AS (
  {in_open_slices}
), singles AS (
  SELECT {keys}, bucket, slice, value, count(1) AS cnt
  FROM in_slices GROUP BY ALL
), placed_singles AS (
  SELECT *, sum(cnt) OVER (PARTITION BY {keys}, bucket, slice ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto
  FROM singles
), found AS (
  SELECT {keys}, p, side, n, lo AS value FROM first_pass WHERE lo = hi
  UNION ALL
  SELECT {keys}, p, side, n, slo FROM second_pass WHERE slo = shi
  UNION ALL
  SELECT {t_keys}, t.p, t.side, t.n, s.value
  FROM second_pass t JOIN placed_singles s ON {same_ts} AND t.slice = s.slice
  WHERE t.slo < t.shi AND t.within >= s.upto - s.cnt AND t.within < s.upto
), sides AS (
  SELECT {keys}, p, n, max(value) FILTER (WHERE side = 0) AS below, max(value) FILTER (WHERE side = 1) AS above
  FROM found GROUP BY ALL
)
SELECT {out_keys}, p, n, CASE WHEN below = above THEN below
  ELSE below + (above - below) * ((n - 1) * p - floor((n - 1) * p)) END AS quantile
FROM sides
"""


def quantiles_by_counting(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    keys = [*[f"by{i}" for i in range(len(by))], "column"]
    facts = long_values(df, columns, by).withColumn("bucket", log_bucket(F.col("value")))
    few = few_groups(df, by, len(columns) * len(probs) * 2)

    at = [*keys, "bucket"]

    def same(left: str, right: str, low: str = "", high: str = "") -> str:
        equal = [f"{left}.{k} = {right}.{k}" for k in at]
        inside = [f"{left}.value BETWEEN {right}.{low} AND {right}.{high}"] if low else []
        return " AND ".join([*equal, *inside])

    def in_open(places: str, low: str, high: str, piece: str = "") -> str:
        """The facts that lie in an open bucket or slice."""
        chosen = ", ".join([*[f"f.{k}" for k in at], "f.value", f"o.{low}", f"o.{high}", *([f"o.{piece}"] if piece else [])])
        within = same("f", "o", low, high)
        if few:
            # at most groups x columns x probabilities x 2 rows are open
            return f"SELECT /*+ BROADCAST(o) */ {chosen} FROM {{facts}} f JOIN {places} o ON {within}"
        return f"""SELECT /*+ BROADCAST(o) */ {chosen} FROM {{facts}} f
    JOIN (SELECT * FROM {places} WHERE rows > {HOT_ROWS}) o ON {within}
  UNION ALL
  SELECT {chosen} FROM (
    SELECT /*+ BROADCAST(h) */ f.* FROM {{facts}} f
      LEFT ANTI JOIN (SELECT * FROM {places} WHERE rows > {HOT_ROWS}) h ON {same('f', 'h', low, high)}) f
    JOIN (SELECT * FROM {places} WHERE rows <= {HOT_ROWS}) o ON {within}"""
    text = PASSES.format(
        keys=", ".join(keys), t_keys=", ".join(f"t.{k}" for k in keys),
        probs="array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")",
        in_open_buckets=in_open("open_buckets", "lo", "hi"), in_open_slices=in_open("open_slices", "slo", "shi", "slice"),
        slice=f"CASE WHEN hi - lo < double('infinity') THEN floor((value - lo) / (hi - lo) * {SLICES!r}D) ELSE 0 END",
        same_ts=same("t", "s"), out_keys=", ".join([*[f"by{i} AS {quoted(b)}" for i, b in enumerate(by)], "column"]))
    return df.sparkSession.sql(text, facts=facts)


def fits_buffer(df: DataFrame, by: Sequence[str] = ()) -> bool:
    """Whether no group has more than ``tableglass.quantiles.bufferRows`` rows, so that one buffer can
    hold all its values.

    The first check stops at the first row beyond the limit and reads no column; only where the
    table is larger are the rows of each group counted, from the key columns alone.
    """
    limit = int(df.sparkSession.conf.get("tableglass.quantiles.bufferRows", str(BUFFER_ROWS)))
    if limit <= 0:
        return False
    if not df.select(F.lit(1).alias("one")).offset(limit).take(1):
        return True
    if not by:
        return False
    keys = [value(df, b).alias(f"by{i}") for i, b in enumerate(by)]
    sizes = df.select(*keys).dropna().groupBy(*[f"by{i}" for i in range(len(by))]).agg(F.count(F.lit(1)).alias("rows"))
    return (sizes.agg(F.max("rows").alias("most")).first()["most"] or 0) <= limit


def quantiles_by_buffer(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    """(by..., column, n, quantiles) from the built-in ``percentile``, for tables that fit a buffer."""
    ps = F.array(*[F.lit(float(p)) for p in probs])
    numbers = df.select(*[value(df, b).alias(f"by{i}") for i, b in enumerate(by)],
                        *[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    keys = [f"by{i}" for i in range(len(by))]
    aggregates = [a for i in range(len(columns)) for a in (
        F.percentile(f"v{i}", ps).alias(f"q{i}"), F.count(f"v{i}").alias(f"n{i}"))]
    row = numbers.dropna(subset=keys).groupBy(*keys).agg(*aggregates) if keys else numbers.agg(*aggregates)
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"q{i}").alias("quantiles"))
             for i, c in enumerate(columns)]
    return row.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.inline(F.array(*lines))).filter("n > 0")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    """(by..., column, p, n, quantile): linear interpolation between the two nearest positions.

    Columns (of groups) without values have no rows.
    """
    if not fits_buffer(df, by):
        return quantiles_by_counting(df, columns, probs, by)
    ps = F.array(*[F.lit(float(p)) for p in probs])
    zipped = F.inline(F.arrays_zip(ps.alias("p"), F.col("quantiles").alias("quantile")))
    return quantiles_by_buffer(df, columns, probs, by).select(*[raw(b) for b in by], "column", "n", zipped)


def quantile_columns(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], by: Sequence[str] = (),
) -> DataFrame:
    """(by..., column, n, one DOUBLE per named probability); n counts the values."""
    ordered = sorted(set(probs.values()))
    keys = [raw(b) for b in by]
    if fits_buffer(df, by):
        found = quantiles_by_buffer(df, columns, ordered, by)
        return found.select(*keys, "column", "n", *[
            F.element_at("quantiles", ordered.index(p) + 1).alias(name) for name, p in probs.items()])
    found = quantiles_by_counting(df, columns, ordered, by)
    return found.groupBy(*keys, "column", "n").agg(*[
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in probs.items()])
