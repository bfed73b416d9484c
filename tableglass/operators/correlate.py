"""Correlation of numeric columns: Pearson, Spearman and Kendall (tau-b), pairwise complete."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableglass.functions.columns import number, numeric_columns
from tableglass.functions.moments import pearson
from tableglass.plans.joins import lookup
from tableglass.plans.ranks import few_values, ordered_counts
from tableglass.plans.scratch import scratch_folder, stored
from tableglass.plans.tiles import correlations

STRONG, VERY_STRONG = 0.7, 0.9
BROADCAST_VALUES = 100_000  # ranks are broadcast up to so many; beyond that only those of hot values are
MOST_JOINED = 16  # so many columns are joined with their ranks in place; a broadcast table takes 64 MB at least
PAIRS_PER_BLOCK = 6  # of the Pearson aggregate
WIDE = 16  # more columns than these are multiplied in tiles: rows would be copied once per six pairs, or joined once per column
BLOCK_BITS = 14  # x ranks per block of the inversion count: 2^14
SPAN_BITS = 20  # y ranks up to which the cells of one x value are summed up in one task: 2^20
ROWS_PER_TASK = 1 << 20  # of the inversion count; a cell is a row for each bit of its y rank


def two_or_more(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    chosen = numeric_columns(df, columns)
    if len(chosen) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    return chosen


def numbers_of(df: DataFrame, chosen: Sequence[str]) -> DataFrame:
    return df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(chosen)])


def pearson_pairs(numbers: DataFrame, names: Sequence[str]) -> DataFrame:
    """(var1, var2, r) for every pair of the columns v0, v1...

    Many columns go through matrix products. For a few, one aggregate over all pairs would outgrow generated code from about ten pairs on and run many
    times slower, so each row is split into blocks of a few pairs and aggregated per block.
    """
    if len(names) > WIDE:
        return named_pairs(correlations(numbers, [F.col(c) for c in numbers.columns]), names)
    pairs = list(combinations(range(len(names)), 2))
    blocks = [pairs[i:i + PAIRS_PER_BLOCK] for i in range(0, len(pairs), PAIRS_PER_BLOCK)]
    width = min(PAIRS_PER_BLOCK, len(pairs))
    none = F.lit(None).cast("double")

    def block(at: int, members: list[tuple[int, int]]) -> Column:
        filled = [(F.col(f"v{i}"), F.col(f"v{j}")) for i, j in members] + [(none, none)] * (width - len(members))
        return F.struct(F.lit(at).alias("block"), *[
            c for t, (x, y) in enumerate(filled) for c in (x.alias(f"x{t}"), y.alias(f"y{t}"))])
    split = numbers.select(F.inline(F.array(*[block(at, members) for at, members in enumerate(blocks)])))
    found = split.groupBy("block").agg(*[pearson(F.col(f"x{t}"), F.col(f"y{t}")).alias(f"r{t}") for t in range(width)])
    lines = found.select("block", F.posexplode(F.array(*[f"r{t}" for t in range(width)])).alias("t", "r")).select(
        (F.col("block") * width + F.col("t")).alias("place"), "r")
    listed = numbers.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(at).alias("place"), F.lit(names[i]).alias("var1"), F.lit(names[j]).alias("var2"))
        for at, (i, j) in enumerate(pairs)])))
    return listed.join(F.broadcast(lines), "place", "left").select("var1", "var2", "r")


def numbered_pairs(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(i, j, var1, var2) of all pairs i < j."""
    k, place, name = len(names), F.col("id"), F.array(*[F.lit(c) for c in names])
    pairs = spark.range(0, k * k, 1, 1 if k <= 100 else None).select((place / k).cast("int").alias("i"), (place % k).cast("int").alias("j")).filter("i < j")
    return pairs.select("i", "j", F.get(name, F.col("i")).alias("var1"), F.get(name, F.col("j")).alias("var2"))


def named_pairs(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """(var1, var2, r) of all pairs i < j, with NULL where nothing was found; ``found`` has (i, j, r)."""
    return numbered_pairs(found.sparkSession, names).join(found, ["i", "j"], "left").select("var1", "var2", "r")


def corr_pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(var1, var2, r) for every pair of numeric columns, in one pass; NULL if either is constant."""
    chosen = two_or_more(df, columns)
    return pearson_pairs(numbers_of(df, chosen), chosen)


def cells(df: DataFrame, chosen: Sequence[str], distinct: Sequence[int] | None = None, without: Sequence[str] = ()) -> DataFrame:
    """(i, j, x, y, c): how often each combination of values occurs, for every pair of columns by their places.

    x is the first column of the pair, or with ``distinct`` given the one with more distinct values. Pairs of two columns in
    ``without`` are left out.
    """
    numbers = numbers_of(df, chosen)
    pairs, known = [], set(without)
    for i, j in combinations(range(len(chosen)), 2):
        if chosen[i] in known and chosen[j] in known:
            continue
        x, y = (j, i) if distinct and distinct[i] < distinct[j] else (i, j)
        pairs.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{x}").alias("x"), F.col(f"v{y}").alias("y")))
    return numbers.select(F.inline(F.array(*pairs))).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*PAIR, "x", "y").agg(
        F.count(F.lit(1)).alias("c"))


PAIR = ["i", "j"]  # numbers, as they are part of every row


def side_ranks(counted: DataFrame, side: str, few: bool) -> DataFrame:
    values = counted.groupBy(*PAIR, F.col(side).alias("value")).agg(F.sum("c").alias("cnt"))
    return ordered_counts(values, PAIR, few)


def value_facts(numbers: DataFrame) -> tuple[list[bool], list[int]]:
    """(whether anything is missing, about how many distinct values there are) of each column: one row."""
    row = numbers.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in numbers.columns], *[
        F.approx_count_distinct(c).alias(f"d_{c}") for c in numbers.columns]).first()
    return [row[f"n_{c}"] < row["rows"] for c in numbers.columns], [row[f"d_{c}"] for c in numbers.columns]


def every_pair(df: DataFrame, chosen: Sequence[str], found: DataFrame) -> DataFrame:
    """(var1, var2, r) in column order, with NULL where nothing was found (no complete rows)."""
    listed = numbered_pairs(df.sparkSession, chosen)
    return listed.join(F.broadcast(found) if len(chosen) <= WIDE else found, PAIR, "left").select("var1", "var2", "r")


def centred_rank() -> Column:
    """The average rank of the value less the mean rank (total + 1) / 2."""
    return F.col("before") + (F.col("cnt") + 1) / 2.0 - (F.col("total") + 1) / 2.0


def corr_spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(var1, var2, r): Pearson's coefficient of the average ranks among the rows complete for the pair.

    Whether values are missing is counted first. Without any, a column has the same ranks in every
    pair: they are looked up once per column. Otherwise each pair has its own ranks. Of many columns those
    without missing values are ranked together, and only pairs with another one go by pair.
    """
    chosen = two_or_more(df, columns)
    numbers = numbers_of(df, chosen)
    lacking, distinct = value_facts(numbers)
    few = few_values(max(distinct))
    whole = [c for c, some in zip(chosen, lacking) if not some]
    if len(whole) > WIDE:
        found = spearman_of_whole(df, whole)
        if len(whole) == len(chosen):
            return found
        return spearman_by_pair(df, chosen, few, distinct, found, whole)
    if any(lacking):
        return spearman_by_pair(df, chosen, few, distinct)
    ranked = numbers
    for c in numbers.columns:
        values = numbers.groupBy(F.lit(0).alias("key"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
        ranks = ordered_counts(values, ["key"], few).select(F.col("value").alias(c), centred_rank().alias(f"rank_{c}"), "cnt")
        ranked = lookup(ranked, ranks, [c], max(distinct) <= BROADCAST_VALUES, "cnt").drop(c, "cnt")
    return pearson_pairs(ranked.select(*[F.col(f"rank_{c}").alias(c) for c in numbers.columns]), chosen)


def on_side(counted: DataFrame, ranks: DataFrame, side: str, few: bool) -> DataFrame:
    """The cells with the rank of one side's value. A value that many rows have may stand in as many cells, so the hot ones are
    broadcast."""
    return lookup(counted, ranks, [*PAIR, side], few, "cnt").drop("cnt")


def spearman_of_whole(df: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """(var1, var2, r) of columns without missing values. Ranks of columns with few values are broadcast and stay in their row. The cells of the others
    are ranked column by column together, and meet again by row: as many narrow rows are shuffled, however many pairs there are."""
    path = scratch_folder(df.sparkSession)
    numbers_of(df, chosen).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)  # so that rows keep their numbers
    numbers = df.sparkSession.read.parquet(path)
    distinct = value_facts(numbers.drop("row"))[1]
    narrow, values = [], 0
    for i in sorted(range(len(chosen)), key=lambda i: distinct[i])[:MOST_JOINED]:
        values += distinct[i]
        if values <= BROADCAST_VALUES:
            narrow.append(i)
    others = [i for i in range(len(chosen)) if i not in narrow]

    def ranked_cells(columns: Sequence[int]) -> tuple[DataFrame, DataFrame]:
        own = numbers.select("row", F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("value")) for i in columns])))
        counts = own.groupBy("c", "value").agg(F.count(F.lit(1)).alias("cnt"))
        return own, ordered_counts(counts, ["c"], few_values(max(distinct[i] for i in columns))).select("c", "value", centred_rank().alias("rank"), "cnt")
    rows = numbers
    if narrow:
        known = scratch_folder(df.sparkSession)
        ranked_cells(narrow)[1].write.parquet(known)
        for i in narrow:
            ranks = df.sparkSession.read.parquet(known).filter(F.col("c") == i).select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"rank{i}"))
            rows = rows.join(F.broadcast(ranks), f"v{i}")
    vectors = rows.select("row", F.array(*[F.col(f"rank{i}") for i in narrow]).alias("near"))
    if others:
        cells_of, ranks = ranked_cells(others)
        far = lookup(cells_of, ranks, ["c", "value"], sum(distinct[i] for i in others) <= BROADCAST_VALUES, "cnt").groupBy("row").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("c", "rank"))), lambda x: x["rank"]).alias("far"))
        vectors = vectors.join(far, "row") if narrow else far
    place = {i: F.get("near", F.lit(n)) for n, i in enumerate(narrow)} | {i: F.get("far", F.lit(n)) for n, i in enumerate(others)}
    return named_pairs(correlations(vectors, [place[i] for i in range(len(chosen))]), chosen)


def spearman_by_pair(
    df: DataFrame, chosen: Sequence[str], few: bool, distinct: Sequence[int], known: DataFrame | None = None, of: Sequence[str] = (),
) -> DataFrame:
    """Each pair's own ranks; pairs of two columns named in ``of`` are ``known``."""
    counted = cells(df, chosen, without=of)
    all_few = max(distinct) * len(chosen) ** 2 <= BROADCAST_VALUES
    x = side_ranks(counted, "x", few).select(*PAIR, F.col("value").alias("x"), centred_rank().alias("dx"), "cnt")
    y = side_ranks(counted, "y", few).select(*PAIR, F.col("value").alias("y"), centred_rank().alias("dy"), "cnt")
    c, dx, dy = F.col("c").cast("double"), F.col("dx"), F.col("dy")
    spread = F.sqrt(F.sum(c * dx * dx)) * F.sqrt(F.sum(c * dy * dy))
    found = on_side(on_side(counted, x, "x", all_few), y, "y", all_few).groupBy(*PAIR).agg(
        F.try_divide(F.sum(c * dx * dy), spread).alias("r"))
    if known:
        found = found.unionByName(numbered_pairs(df.sparkSession, chosen).join(known, ["var1", "var2"]).select(*PAIR, "r"))
    return every_pair(df, chosen, found)


def pairs_of(count: Column) -> Column:
    n = count.cast("double")
    return n * (n - 1.0) / 2.0


def corr_kendall(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(var1, var2, r): tau-b, exact at any size.

    Discordant pairs are inversions of the dense y rank in the order of x. Two ranks differ first
    in one bit, so each inversion is counted at exactly that bit, among the ranks that agree in
    all higher bits: a row with bit 0 is discordant with the earlier rows (smaller x) with bit 1.
    Per bit and prefix that is a running sum over x, taken in blocks of x ranks plus a running sum
    over the blocks. Each row is copied once per bit; no two rows are ever paired.
    """
    chosen = two_or_more(df, columns)
    # tau does not depend on which column is y; the one with fewer values has fewer bits
    _, distinct = value_facts(numbers_of(df, chosen))
    counted, few = stored(cells(df, chosen, distinct)), few_values(max(distinct))
    xs, ys = stored(side_ranks(counted, "x", few)), stored(side_ranks(counted, "y", few))
    # each value of a pair is one row: of x the larger number of the two columns, of y the smaller
    rows_x = sum(max(p) for p in combinations(distinct, 2))
    rows_y = sum(min(p) for p in combinations(distinct, 2))
    ranked = on_side(counted, xs.select(*PAIR, F.col("value").alias("x"), F.col("dense").alias("xr"), "cnt"), "x", rows_x <= BROADCAST_VALUES)
    ranked = on_side(ranked, ys.select(*PAIR, F.col("value").alias("y"), F.col("dense").alias("yr"), "cnt"), "y", rows_y <= BROADCAST_VALUES)
    bits = max(min(p) for p in combinations(distinct, 2)).bit_length()
    discordant = inversions(ranked, ys, counted.count() * bits // ROWS_PER_TASK + 1)

    def ties(of: DataFrame, count: str, name: str) -> DataFrame:
        return of.groupBy(*PAIR).agg(F.sum(pairs_of(F.col(count))).alias(name))
    tied_x = xs.groupBy(*PAIR).agg(F.sum(pairs_of(F.col("cnt"))).alias("tx"), F.max("total").alias("n"))
    together = tied_x.join(ties(ys, "cnt", "ty"), PAIR).join(ties(counted, "c", "txy"), PAIR).join(discordant, PAIR)
    n0 = pairs_of(F.col("n"))
    concordant = n0 - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d")
    spread = F.sqrt(n0 - F.col("tx")) * F.sqrt(n0 - F.col("ty"))
    found = together.select(*PAIR, F.try_divide(concordant - F.col("d"), spread).alias("r"))
    return every_pair(df, chosen, found)


def inversions(ranked: DataFrame, ys: DataFrame, tasks: int) -> DataFrame:
    """(i, j, d): the discordant pairs of the cells (xr, yr, c).

    Rows are dealt to as many ``tasks`` as their number asks for, in each step. Otherwise they would stay where the ranks were
    made, which is one task for a pair of columns, or come together as their bytes allow before they are copied.
    """
    # one row per pair of columns
    depth = ys.groupBy(*PAIR).agg(F.greatest(F.length(F.bin(F.max("dense"))), F.lit(1)).alias("bits"))
    # an x value that has very many cells is spread over tasks; the range of the running sum leaves out all its rows
    dealt = ranked.withColumn("span", F.shiftright("yr", SPAN_BITS)).repartition(tasks, *PAIR, "xr", "span")
    levels = dealt.join(F.broadcast(depth), PAIR).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    bit = F.expr("shiftright(yr, level) & 1L")
    split = levels.withColumn("prefix", F.expr("shiftright(yr, level + 1)")).groupBy(
        *PAIR, "xr", "span", "level", "prefix").agg(
        F.sum(F.when(bit == 1, F.col("c")).otherwise(0)).cast("double").alias("ones"),
        F.sum(F.when(bit == 0, F.col("c")).otherwise(0)).cast("double").alias("zeros"),
    ).withColumn("block", F.shiftright("xr", BLOCK_BITS)).drop("span")

    def earlier(of: DataFrame, group: Sequence[str], order: str) -> DataFrame:
        smaller = Window.partitionBy(*group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        return of.repartition(tasks, *group).withColumn("ahead", F.coalesce(F.sum("ones").over(smaller), F.lit(0.0)))
    group = [*PAIR, "level", "prefix"]
    near = earlier(split, [*group, "block"], "xr").groupBy(*group, "block").agg(
        F.sum(F.col("zeros") * F.col("ahead")).alias("d"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    far = earlier(near, group, "block")
    return far.groupBy(*PAIR).agg(F.sum(F.col("d") + F.col("zeros") * F.col("ahead")).alias("d"))


METHODS = {"pearson": corr_pearson, "spearman": corr_spearman, "kendall": corr_kendall}


def correlation(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {list(METHODS)}")
    return METHODS[method](df, columns)


def strong_correlations(
    df: DataFrame, threshold: float = STRONG, n: int = 10, method: str = "pearson", columns: Sequence[str] | None = None,
) -> DataFrame:
    """(var1, var2, correlation, strength, direction): the n strongest pairs beyond the threshold."""
    r = F.col("r")
    return (
        correlation(df, method, columns).filter(F.abs(r) > threshold)
        .select("var1", "var2", F.round(r, 3).alias("correlation"),
                F.when(F.abs(r) > VERY_STRONG, "very strong").otherwise("strong").alias("strength"),
                F.when(r > 0, "positive").otherwise("negative").alias("direction"))
        .orderBy(F.abs(F.col("correlation")).desc(), "var1", "var2").limit(n)
    )


def corr_heatmap(
    df: DataFrame, method: str = "pearson", mask_upper: bool = False, columns: Sequence[str] | None = None,
) -> DataFrame:
    """(row, col, r, label): the matrix in long form, labels with 2 decimal places.

    ``mask_upper`` leaves out the diagonal and all above it.
    """
    chosen = two_or_more(df, columns)
    pairs = correlation(df, method, chosen)
    lower = pairs.select(F.col("var2").alias("row"), F.col("var1").alias("col"), "r")
    matrix = lower
    if not mask_upper:
        spread = df.agg(*[F.stddev_samp(number(df, c)).alias(f"s{i}") for i, c in enumerate(chosen)])
        diagonal = spread.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("row"), F.lit(c).alias("col"), F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("r"))
            for i, c in enumerate(chosen)])))
        # the pairs are computed once and mirrored
        both = F.array(F.struct(F.col("var1").alias("row"), F.col("var2").alias("col"), "r"),
                       F.struct(F.col("var2").alias("row"), F.col("var1").alias("col"), "r"))
        matrix = pairs.select(F.inline(both)).unionAll(diagonal)
    return matrix.withColumn("label", F.round("r", 2))
