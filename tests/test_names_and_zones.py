"""Columns named like an operator's own, and dates under several session time zones."""

import pytest

from tableglass.operators import charts, profile, quality, rows, stats

NAMES = ["count", "n", "y", "bin", "mean", "column", "value", "copies", "rows", "place", "h", "zscore"]


@pytest.fixture(scope="module")
def plain(spark):
    """Groups of three sizes, with numbers that spread."""
    return spark.createDataFrame([(("a", "b", "b", "c", "c", "c")[i % 6], float(i * i % 17), float(i)) for i in range(60)], "k string, v double, w double").cache()


OPERATORS = {
    "value_counts": lambda df, k, v: stats.value_counts(df, k),
    "grouped_mean": lambda df, k, v: stats.grouped_stat(df, v, "mean", k),
    "grouped_median": lambda df, k, v: stats.grouped_stat(df, v, "median", k),
    "grouped_p25": lambda df, k, v: stats.grouped_stat(df, v, "p25", k),
    "grouped_all": lambda df, k, v: stats.grouped_all(df, v, k),
    "freq_top": lambda df, k, v: charts.freq_top(df, k),
    "pie_share": lambda df, k, v: charts.pie_share(df, k),
    "bar_sum": lambda df, k, v: charts.bar_sum(df, k, v),
    "bar_sum_top": lambda df, k, v: charts.bar_sum_top(df, v, k),
    "line_mean_by": lambda df, k, v: charts.line_mean_by(df, v, k),
    "area_series": lambda df, k, v: charts.area_series(df, k, v),
    "hist_by": lambda df, k, v: charts.hist_by(df, v, k),
    "box_summary": lambda df, k, v: charts.box_summary(df, v, k),
    "box_outlier_points": lambda df, k, v: charts.box_outlier_points(df, v, k),
    "violin_density": lambda df, k, v: charts.violin_density(df, v, k),
    "duplicate_count": lambda df, k, v: quality.duplicate_count(df.select(f"`{k}`")),
    "duplicate_rows": lambda df, k, v: quality.duplicate_rows(df.select(f"`{k}`")),
    "outliers_zscore": lambda df, k, v: quality.outliers_zscore(df, v, 1.0),
    "describe_all": lambda df, k, v: profile.describe_all(df.select(f"`{k}`", f"`{v}`")).drop("column"),
}


@pytest.mark.parametrize("operator", OPERATORS)
def test_names_do_not_matter(spark, plain, operator):
    """The result is the same under every name, and no two columns have one name."""
    run = OPERATORS[operator]
    want = sorted(map(tuple, run(plain, "k", "v").collect()), key=str)
    for name in NAMES if operator in ("value_counts", "grouped_all", "box_summary", "duplicate_count") else NAMES[::3] + ["copies", "zscore"]:
        for key, v in ((name, "v"), ("k", name)):
            df = plain.select(plain.k.alias(key), plain.v.alias(v), "w")
            found = run(df, key, v)
            assert len(set(found.columns)) == len(found.columns), (name, found.columns)
            assert sorted(map(tuple, found.collect()), key=str) == want, (name, found.columns)


def test_dates_in_every_zone(spark):
    """A date's hour that a zone skips or repeats, on a clock without zone."""
    texts = ["2024-03-31 02:30:00", "2024-03-31 03:30:00", "2024-10-27 02:30:00", "2024-03-10 02:15:00.123456", "1969-12-31 23:59:59.999999", "0001-01-01 00:00:00"]
    results = set()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Paris", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("cast(t AS timestamp_ntz) AS t")
            epoch = sorted(r["t_epoch"] for r in rows.datetime_to_epoch(df, "t").collect())
            assert epoch[1:3] == [-1, 1710036900123456]
            shown = [str(x) for r in (
                stats.stat(df, "t", "median").collect(), stats.stat(df.filter("t > '2000-01-01'"), "t", "mean").collect(), stats.stat(df, ["t"], "nunique").collect(),
                profile.describe_all(df).collect()) for x in r]
            results.add((tuple(epoch), *shown))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(results) == 1
    assert "nunique=6" in str(results)
