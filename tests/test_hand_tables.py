"""Small tables with known answers: nulls, NaN, ties, constants, few rows, no rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableglass.operators import charts, clean, correlate, profile, quality, rows, stats

NAN = float("nan")


def one(df):
    (row,) = df.collect()
    return row


def as_dict(df, key="column"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "x double, n int, s string, t timestamp_ntz, b boolean")


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame(
        [(1.0, 1, "b", True, "k"), (NAN, 2, "b", False, "k"), (None, None, "a", None, None), (4.0, 4, "a", True, "m")],
        "x double, n int, s string, b boolean, g string")


def test_nan_is_missing(mixed):
    assert one(stats.stat(mixed, "x", "mean"))["mean"] == 2.5
    assert one(stats.stat(mixed, "x", "max"))["max"] == 4.0
    assert one(stats.stat(mixed, "x", "count"))["count"] == 2
    assert one(stats.stat(mixed, "x", "median"))["median"] == 2.5
    assert one(stats.null_counts(mixed, ["x"])) == ("x", 2, 50.0)
    assert rows.filter_compare(mixed, "x", ">", 0).count() == 2


def test_operation_names(mixed):
    assert one(stats.stat(mixed, "x", "moyenne"))["moyenne"] == 2.5
    assert one(stats.stat(mixed, "x", "percentile_75"))["percentile_75"] == 3.25
    assert stats.stat(mixed, ["x", "n"], "anything").columns == ["column", "mean", "std", "min", "max", "median", "count"]
    grouped = as_dict(stats.grouped_stat(mixed, "n", "ecart_type", "g"), "g")
    assert grouped["k"]["ecart_type_n"] == pytest.approx(math.sqrt(0.5)) and grouped["m"]["ecart_type_n"] is None


def test_group_keys_that_are_missing_are_dropped(mixed):
    assert {r["g"] for r in stats.grouped_stat(mixed, "x", "sum", "g").collect()} == {"k", "m"}
    assert {r["g"] for r in stats.grouped_all(mixed, "x", "g").collect()} == {"k", "m"}
    by_nan = mixed.select("x", "n")
    assert {r["x"] for r in stats.grouped_stat(by_nan, "n", "max", "x").collect()} == {1.0, 4.0}


def test_group_without_values_keeps_its_row(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, x double")
    got = as_dict(stats.grouped_stat(df, "x", "median", "g"), "g")
    assert got["a"]["median_x"] is None and got["b"]["median_x"] == 2.0
    assert as_dict(stats.grouped_stat(df, "x", "sum", "g"), "g")["a"]["sum_x"] == 0.0


def test_integers_stay_integers_and_text_is_skipped(mixed):
    assert one(stats.stat(mixed, ["n", "s"], "sum")) == ("n", 7)
    assert dict(stats.stat(mixed, ["n"], "sum").dtypes)["sum"] == "bigint"
    with pytest.raises(ValueError):
        stats.stat(mixed, ["s"], "mean")
    with pytest.raises(ValueError):
        stats.stat(mixed, ["absent"], "mean")


def test_booleans(mixed):
    assert one(stats.stat(mixed, "b", "mean"))["mean"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        stats.stat(mixed, "b", "median")
    assert as_dict(profile.logical_types(mixed))["b"]["logical_type"] == "binary_numeric"
    assert as_dict(profile.describe_all(mixed))["b"]["top"] == "true"


def test_shape_statistics_of_few_values(spark):
    def of(values, name):
        return one(stats.stat(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", name))[name]
    assert of([1, 2], "skewness") is None and of([1, 2, 4], "kurtosis") is None
    assert of([3, 3, 3, 3], "skewness") == 0.0 and of([3, 3, 3, 3], "kurtosis") == 0.0
    series = pd.Series([1, 2, 4, 9, 3.5])
    assert of(series, "skewness") == pytest.approx(series.skew())
    assert of(series, "kurtosis") == pytest.approx(series.kurtosis())
    assert of([5], "std") is None


def test_mode_takes_the_least_of_ties(mixed):
    assert one(stats.stat_mode(mixed, "s"))["mode"] == "a"
    assert one(stats.quick_stats_categorical(mixed, "s"))["mode"] == "a"
    assert [tuple(r) for r in stats.value_counts(mixed, "s").collect()] == [("a", 2), ("b", 2)]


def test_empty_table(empty):
    assert one(stats.stat(empty, "x", "sum"))["sum"] == 0.0
    assert one(stats.stat(empty, "x", "mean"))["mean"] is None
    assert one(stats.stat(empty, "x", "median"))["median"] is None
    assert one(stats.quick_stats_numeric(empty, ["x"]))["p25"] is None
    assert one(stats.quick_stats_categorical(empty, "s"))["mode"] is None
    assert one(profile.profile_overview(empty))["rows"] == 0
    assert all(r["is_category"] is False for r in profile.detect_categorical(empty).collect())
    assert as_dict(profile.dtypes_report(empty))["x"]["unique_ratio"] == 0
    assert profile.describe_all(empty).count() == 5
    assert one(quality.duplicate_count(empty))["duplicates"] == 0
    assert quality.missing_report(empty).count() == 0 and quality.outliers_iqr_all(empty).count() == 0
    assert charts.hist_numeric(empty, "x").count() == 0 and charts.violin_density(empty, "x").count() == 0
    assert "EMPTY_TABLE" in {r["code"] for r in quality.quality_rules(empty, ["x"], "s").collect()}
    assert clean.fill_mean(empty, "x").count() == 0
    assert [r["r"] for r in correlate.corr_pearson(empty).collect()] == [None]
    assert [r["r"] for r in correlate.corr_kendall(empty).collect()] == [None]


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert [tuple(r) for r in clean.fill_mean(df, "x").collect()] == [(None, 1.0), (None, 2.0)]
    assert [tuple(r) for r in clean.fill_mode(df, "x").collect()] == [(None, 1.0), (None, 2.0)]
    assert as_dict(profile.profile_numeric(df))["x"]["mean"] is None
    _, report = clean.clean_pipeline(df, [{"type": "fill_missing", "column": "x", "method": "mode"}])
    assert one(report)["filled"] == 0


def test_head_tail_sample(spark):
    df = spark.range(100).withColumn("k", 99 - F.col("id"))
    assert [r["id"] for r in rows.head(df, "k", 3).collect()] == [99, 98, 97]
    assert [r["id"] for r in rows.tail(df, "id", 3).collect()] == [97, 98, 99]
    assert rows.sample_rows(df, 1000).count() == 100
    sample = {r["id"] for r in rows.sample_rows(df, 10, seed=3, key="id").collect()}
    hashed = df.select("id", F.md5(F.concat_ws("|", F.lit("3"), F.col("id").cast("string"))).alias("h")).collect()
    assert sample == {r["id"] for r in sorted(hashed, key=lambda r: r["h"])[:10]}
    assert sample != {r["id"] for r in rows.sample_rows(df, 10, seed=4, key="id").collect()}


def test_drop_and_select(mixed):
    assert rows.drop_column(mixed, "absent").columns == mixed.columns
    with pytest.raises(ValueError):
        rows.select_columns(mixed, ["absent"])
    with pytest.raises(ValueError):
        rows.filter_compare(mixed, "x", "!=", 1)


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1.0, "u"), (2.0, "v"), (2.0, "v")], "`a.b` double, `c``d` string")
    assert one(stats.stat(df, "a.b", "median"))["median"] == 2.0
    assert as_dict(stats.grouped_stat(df, "a.b", "median", "c`d"), "c`d")["v"]["median_a.b"] == 2.0
    assert profile.describe_all(df).count() == 2 and quality.duplicate_count(df).first()["duplicates"] == 1
    assert profile.profile_categorical(df).count() == 2
    assert clean.remove_duplicates(df).count() == 2


def test_duplicates_with_nan_null_and_maps(spark):
    df = spark.createDataFrame(
        [(NAN, {"a": 1, "b": 2}), (None, {"b": 2, "a": 1}), (0.0, None), (-0.0, None)], "x double, m map<string,int>")
    assert one(quality.duplicate_count(df))["duplicates"] == 2
    assert clean.remove_duplicates(df).count() == 2
    assert quality.duplicate_rows(spark.createDataFrame([(1,), (1,), (2,), (1,)], "x int"), 2).count() == 2


def test_missing_report_and_recommendations(mixed):
    report = quality.missing_report(mixed).collect()
    assert [r["column"] for r in report] == ["x", "b", "g", "n"]
    assert report[0]["class"] == "numeric" and report[0]["pct"] == 50.0 and report[0]["total_missing"] == 5
    assert {r["column"]: r["strategy"] for r in quality.missing_recommendations(mixed).collect()} == {
        "x": "fill_mean", "n": "fill_mean", "b": "fill_mode", "g": "fill_mode"}


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(10), 100]] + [(None,)], "x double")
    got = one(quality.outliers_iqr(df, "x"))
    assert (got["q1"], got["q3"], got["outliers"]) == (2.5, 7.5, 1) and got["pct"] == pytest.approx(100 / 12)
    assert one(quality.outlier_rows(df, "x"))["x"] == 100.0
    assert one(quality.outlier_extremes(df)) == ("x", 0.0, 100.0, 100.0, 100.0)
    assert quality.outliers_zscore(df, "x", 2.0).count() == 1
    constant = spark.createDataFrame([(1.0,)] * 12, "x double")
    assert quality.outliers_zscore(constant, "x").count() == 0 and quality.outliers_iqr_all(constant).count() == 0


def test_fill_and_pipeline(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (4, None)], "n int, s string")
    assert sorted(r["n"] for r in clean.fill_mean(df, "n").collect()) == [1, 1, 2, 4]
    assert sorted(r["n"] for r in clean.fill_median(df, "n").collect()) == [1, 1, 1, 4]
    assert sorted(r["s"] for r in clean.fill_constant(df, "s").collect()) == ["UNKNOWN", "a", "a", "b"]
    assert sorted(r["n"] for r in clean.fill_constant(df, "n").collect()) == ["1", "1", "4", "UNKNOWN"]
    assert clean.fill_mean(df, "s").collect() == df.collect()
    # the mean is taken after the duplicates are gone: (1 + 4) / 2
    table, report = clean.clean_pipeline(df, [
        {"type": "remove_duplicates"}, {"type": "fill_missing", "column": "n", "method": "mean"},
        {"type": "fill_missing", "column": "s", "method": "constant", "value": "z"},
        {"type": "fill_missing", "column": "gone", "method": "mean"}, {"type": "drop_column", "column": "s"}])
    assert sorted(r["n"] for r in table.collect()) == [1.0, 2.5, 4.0] and table.columns == ["n"]
    assert [(r["type"], r["rows_removed"], r["filled"]) for r in report.orderBy("step").collect()] == [
        ("remove_duplicates", 1, None), ("fill_missing", None, 1), ("fill_missing", None, 1), ("drop_column", None, None)]
    # filled twice: the second time nothing is missing
    _, twice = clean.clean_pipeline(df, [{"type": "fill_missing", "column": "n", "method": "mean"}] * 2)
    assert [r["filled"] for r in twice.orderBy("step").collect()] == [1, 0]


def test_pipeline_with_checkpoint(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "n int")
    if not spark.conf.get("spark.checkpoint.dir", None):
        from tableglass.plans.scratch import scratch_folder
        spark.sparkContext.setCheckpointDir(scratch_folder(spark))
    table, report = clean.clean_pipeline(df, [
        {"type": "remove_duplicates"}, {"type": "fill_missing", "column": "n", "method": "mean"}], checkpoint=True)
    assert sorted(r["n"] for r in table.collect()) == [1.0, 1.0]
    assert report.orderBy("step").first()["rows_after"] == 2


def kendall(x, y):
    """tau-b from all pairs."""
    up = down = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y), 2):
        s = np.sign(a - c) * np.sign(b - d)
        up, down, tx, ty = up + (s > 0), down + (s < 0), tx + (a == c), ty + (b == d)
    n0 = len(x) * (len(x) - 1) / 2
    return (up - down) / math.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("few", [True, False])
def test_rank_correlations_against_brute_force(spark, few, monkeypatch):
    if not few:
        import tableglass.plans.ranks as ranks
        monkeypatch.setattr(ranks, "FEW_VALUES", 0)
        monkeypatch.setattr(ranks, "VALUES_PER_PART", 3.0)
        monkeypatch.setattr(correlate, "BLOCK_BITS", 2)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, 90).astype(float)
    y = np.round(x * 0.3 + rng.normal(size=90), 1)
    z = rng.normal(size=90)
    frame = pd.DataFrame({"x": x, "y": y, "z": z})
    df = spark.createDataFrame([tuple(map(float, r)) for r in frame.to_numpy()], "x double, y double, z double")
    rank = {(r["var1"], r["var2"]): r["r"] for r in correlate.corr_spearman(df).collect()}
    tau = {(r["var1"], r["var2"]): r["r"] for r in correlate.corr_kendall(df).collect()}
    ranks_of = frame.rank()
    for a, b in itertools.combinations(frame.columns, 2):
        assert rank[(a, b)] == pytest.approx(ranks_of[a].corr(ranks_of[b]))
        assert tau[(a, b)] == pytest.approx(kendall(frame[a], frame[b]))
    holes = df.withColumn("y", F.when(F.col("x") != 3, F.col("y")))
    kept = frame[frame.x != 3]
    rank = {(r["var1"], r["var2"]): r["r"] for r in correlate.corr_spearman(holes).collect()}
    assert rank[("x", "y")] == pytest.approx(kept.x.rank().corr(kept.y.rank()))
    assert rank[("x", "z")] == pytest.approx(ranks_of.x.corr(ranks_of.z))
    tau = {(r["var1"], r["var2"]): r["r"] for r in correlate.corr_kendall(holes).collect()}
    assert tau[("x", "y")] == pytest.approx(kendall(kept.x, kept.y))


def test_correlation_of_constants_and_of_too_few_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "a double, b double, c double")
    got = {(r["row"], r["col"]): r["r"] for r in correlate.corr_heatmap(df).collect()}
    assert got[("a", "a")] == 1.0 and got[("c", "c")] is None and got[("a", "c")] is None
    assert got[("a", "b")] == got[("b", "a")] and len(got) == 9
    assert {(r["row"], r["col"]) for r in correlate.corr_heatmap(df, mask_upper=True).collect()} == {
        ("b", "a"), ("c", "a"), ("c", "b")}
    assert one(correlate.strong_correlations(df))["strength"] == "very strong"
    with pytest.raises(ValueError):
        correlate.corr_pearson(df.select("a"))


def test_pearson_of_many_columns(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(40, 9)), columns=[f"c{i}" for i in range(9)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in frame.to_numpy()], ", ".join(f"c{i} double" for i in range(9)))
    got = {(r["var1"], r["var2"]): r["r"] for r in correlate.corr_pearson(df).collect()}
    expected = frame.corr()
    assert len(got) == 36 and all(v == pytest.approx(expected.loc[a, b]) for (a, b), v in got.items())


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "x double")
    got = charts.hist_numeric(df, "x", 10).orderBy("bin").collect()
    assert [r["count"] for r in got] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2] and got[-1]["upper"] == 10.0
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert one(charts.hist_numeric(constant, "x"))["count"] == 2


def test_charts_choose_their_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", 3.0, 4), ("a", 5.0, 6)], "s string, x double, n int")
    assert [tuple(r) for r in charts.chart_data(df, "bar").orderBy("s").collect()] == [("a", 6.0), ("b", 3.0)]
    assert [r["count"] for r in charts.chart_data(df, "pie").collect()] == [2, 1]
    assert charts.chart_data(df, "histogram").columns == ["bin", "lower", "upper", "count"]
    assert charts.chart_data(df, "scatter", x="x", y="n").count() == 3
    assert charts.chart_data(df, "box", x="s", y="x").count() == 2
    assert charts.chart_data(df, "line", x="n", y="x", aggregate=True).columns == ["n", "x"]
    with pytest.raises(ValueError):
        charts.chart_data(df, "radar")
    area = charts.area_series(df, "n", "x", "s").collect()
    assert [r["top"] for r in area] == [1.0, 3.0, 5.0]


def test_box_whiskers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 50]] + [("b", 1.0), (None, 9.0)], "g string, y double")
    got = as_dict(charts.box_summary(df, "y", "g"), "g")
    assert set(got) == {"a", "b"} and got["a"]["whisker_high"] == 5.0 and got["a"]["outliers"] == 1
    assert one(charts.box_outlier_points(df, "y", "g")) == ("a", 50.0)


def test_warnings(spark):
    df = spark.range(1200).select(
        F.col("id").alias("user_id"), F.lit("same").alias("c"), F.col("id").cast("string").alias("name"),
        F.when(F.col("id") == 0, 1).alias("mostly_null"))
    got = {(r["warning"], r["column"]) for r in profile.profile_warnings(df).collect()}
    assert got == {("potential_id", "user_id"), ("constant", "c"), ("high_cardinality", "name"),
                   ("almost_empty", "mostly_null"), ("constant", "mostly_null")}


def test_profile_tables(mixed):
    tables = profile.profile(mixed)
    assert set(tables) == {"overview", "columns", "numeric", "categorical", "warnings"}
    assert as_dict(tables["numeric"])["n"]["zeros"] == 0
    assert all(t.columns for t in tables.values()) and tables["categorical"].count() == 4
    assert profile.explore(mixed, "head", order_by="n", n=2).count() == 2


@pytest.mark.parametrize("nulls", [False, True])
def test_ranks_of_hot_values(spark, monkeypatch, nulls):
    """The same coefficients where ranks are not broadcast but for hot values."""
    df = spark.range(400).select(
        F.when((F.col("id") % 7 == 0) & F.lit(nulls), None).otherwise(F.col("id") % 40).alias("a"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.sqrt("id")).alias("b"), ((F.col("id") * 37) % 101).alias("c"))
    tables = (correlate.corr_spearman, correlate.corr_kendall)
    want = [{tuple(r)[:2]: r["r"] for r in t(df).collect()} for t in tables]
    monkeypatch.setattr(correlate, "BROADCAST_VALUES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("tableglass.joins.hotRows", "20")
    try:
        got = [{tuple(r)[:2]: r["r"] for r in t(df).collect()} for t in tables]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("tableglass.joins.hotRows")
    for w, g in zip(want, got):
        assert w.keys() == g.keys() and all(g[k] == pytest.approx(w[k]) for k in w)


def test_line_points_draw_the_same_line(spark):
    """In every column of pixels the reduced line starts, ends, falls and rises where the whole one does."""
    import random

    from tableglass.operators import charts
    rng = random.Random(1)
    rows = [(float(rng.randint(0, 999)), rng.choice("ab"), rng.gauss(0, 5)) for _ in range(5000)] + [(None, "a", 1.0), (5.0, "a", None), (5.0, None, 99.0), (7.0, "a", float("nan"))]
    df = spark.createDataFrame(rows, "x double, k string, y double").repartition(4)
    few = [tuple(r) for r in charts.line_points(df, "x", "y", "k", max_points=40).collect()]
    assert len(few) <= 4 * 40 * 3

    def columns(points):
        found = {}
        for x, y, k in points:
            found.setdefault((k, min(int(x / 999.0 * 40), 39)), []).append((x, y))
        return {c: (min(p), max(p), min(y for _, y in p), max(y for _, y in p)) for c, p in found.items()}
    assert columns(few) == columns([(x, y, k) for x, k, y in rows if x is not None and y is not None and y == y])
    assert [r[0] for r in few] == sorted(r[0] for r in few)
    one = charts.line_auto(df, "x", "y", aggregate=False, max_points=10)
    assert one.columns == ["x", "y"] and one.count() <= 40
    assert charts.line_auto(df.limit(0), "x", "y", "k", aggregate=False).collect() == []
    assert charts.line_auto(df, "x", "y", "k", aggregate=False, max_points=None).count() == len(rows)
