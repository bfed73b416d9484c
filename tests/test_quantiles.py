"""Exact quantiles by counting against numpy, on data chosen to be awkward."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableglass.operators import quality, stats
from tableglass.plans.quantiles import quantiles_by_counting

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(spark, groups):
    rows = [(g, float(v) if v is not None else None) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["p"]): r["quantile"] for r in quantiles_by_counting(df, ["x"], PROBS, ["g"]).collect()}
    for g, vs in groups.items():
        present = np.array([v for v in vs if v is not None and not np.isnan(v)])
        for p in PROBS:
            if len(present):
                assert got[(g, p)] == pytest.approx(np.quantile(present, p), rel=1e-12, abs=1e-12)
            else:
                assert (g, p) not in got


def test_awkward_values(spark):
    rng = np.random.default_rng(5)
    check(spark, {
        "normal": rng.normal(size=500),
        "narrow": 1e9 + rng.random(400),                      # all in one bucket
        "very narrow": 1.0 + rng.integers(0, 40, 300) * 2.0**-50,  # all in one slice of one bucket
        "wide": np.exp(rng.normal(size=300) * 200),
        "signs": rng.normal(size=101) * 1e-300,
        "hot": np.r_[np.zeros(300), rng.random(100)],
        "zeros": [0.0, -0.0, 0.0],
        "one": [7.5],
        "two": [1.0, 2.0],
        "missing": [None, float("nan")],
        "mixed": [None, 3.0, float("nan"), 1.0],
    })


def test_many_groups_with_hot_buckets(spark, monkeypatch):
    """The form for more groups than a broadcast takes, with some buckets and slices held to be hot."""
    from tableglass.plans import quantiles
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(quantiles, "HOT_ROWS", 3)
    rng = np.random.default_rng(6)
    few = {f"g{i}": np.round(rng.normal(size=rng.integers(1, 9)), 1) for i in range(40)}
    check(spark, few | {"narrow": 1e9 + rng.random(200), "very narrow": 1.0 + rng.integers(0, 40, 200) * 2.0**-50,
                        "clusters": np.r_[1.0 + rng.integers(0, 3, 90) * 2.0**-50, 1.0001 + rng.integers(0, 2, 5) * 2.0**-50]})


def test_lookup_of_hot_groups(spark, monkeypatch):
    from tableglass.operators import charts
    from tableglass.plans import joins
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    few = sorted(normal(charts.box_summary(events, "value", "user_id").collect()))
    monkeypatch.setattr(charts, "few_groups", lambda df, by: False)
    monkeypatch.setattr(joins, "HOT_ROWS", 14)
    assert sorted(normal(charts.box_summary(events, "value", "user_id").collect())) == few


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    got = {r["p"]: r["quantile"] for r in quantiles_by_counting(df, ["x"], [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: float("-inf"), 0.5: 1.5, 1.0: float("inf")}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=30))
def test_any_values(spark, values):
    check(spark, {"g": values})


def test_several_columns_and_integers(spark):
    df = spark.range(1, 2001).select("id", (F.col("id") % 7).alias("seven"), (-F.col("id")).cast("decimal(20,2)").alias("neg"))
    got = {(r["column"], r["p"]): r["quantile"] for r in quantiles_by_counting(df, ["id", "seven", "neg"], [0.25, 0.5]).collect()}
    assert got[("id", 0.5)] == 1000.5 and got[("id", 0.25)] == 500.75
    assert got[("seven", 0.5)] == 3.0 and got[("neg", 0.5)] == -1000.5


def test_both_ways_agree(spark, counting):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    by_counting = {
        "median": stats.stat(events, ["value", "user_id"], "median").collect(),
        "grouped": sorted(stats.grouped_all(events, "value", "event_type").collect()),
        "fences": quality.outliers_iqr(events, "value").collect(),
        "dates": stats.stat(events, ["ts"], "median").collect(),
    }
    spark.conf.unset("tableglass.quantiles.bufferRows")
    by_buffer = {
        "median": stats.stat(events, ["value", "user_id"], "median").collect(),
        "grouped": sorted(stats.grouped_all(events, "value", "event_type").collect()),
        "fences": quality.outliers_iqr(events, "value").collect(),
        "dates": stats.stat(events, ["ts"], "median").collect(),
    }
    assert {k: normal(v) for k, v in by_counting.items()} == {k: normal(v) for k, v in by_buffer.items()}


def normal(rows):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


def test_key_and_value_may_be_the_same_column(spark, counting):
    df = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert sorted(tuple(r) for r in stats.grouped_stat(df, "x", "median", "x").collect()) == [(1, 1.0), (2, 2.0)]
