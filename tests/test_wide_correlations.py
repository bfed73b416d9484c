"""Correlations of many columns: matrix products in tiles against pandas, shuffles that don't grow with the rows."""

import numpy as np
import pandas as pd
import pytest

from tableglass.operators import correlate
from tableglass.plans import tiles


def frame(rows, columns, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 8))
    x = base @ rng.normal(size=(8, columns)) + rng.normal(size=(rows, columns))
    x *= 10.0 ** rng.integers(-3, 4, columns)
    x += 10.0 ** rng.integers(-3, 4, columns)
    x[:, 5] = 0.1  # constant
    x[rng.random(x.shape) < 0.1 * (np.arange(columns) % 4 == 1)] = np.nan
    x[:, 9] = np.nan
    x[np.isnan(x[:, 1]), 2] = x[np.isnan(x[:, 1]), 2] + 5
    x[~np.isnan(x[:, 13]), 14] = 7.25  # constant where column 13 has a value
    return pd.DataFrame(x, columns=[f"x.{i}" for i in range(columns)])


def same(found, expected):
    got = {(r["var1"], r["var2"]): r["r"] for r in found}
    names = list(expected.columns)
    assert len(got) == len(names) * (len(names) - 1) // 2
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            want = expected.loc[a, b]
            assert (got[a, b] is None) if np.isnan(want) else abs(got[a, b] - want) < 1e-9, (a, b, got[a, b], want)


@pytest.mark.parametrize("columns,strip,tile", [(300, 512, 128), (300, 90, 32), (20, 7, 3)])
def test_pearson(spark, monkeypatch, columns, strip, tile):
    data = frame(700, columns)
    monkeypatch.setattr(tiles, "STRIP", strip)
    monkeypatch.setattr(tiles, "TILE", tile)
    expected = data.corr(min_periods=2)
    expected[abs(expected) < 1e-300] = 0
    expected.loc["x.13", "x.14"] = expected.loc["x.14", "x.13"] = np.nan  # pandas returns rounding
    expected.loc["x.5"] = expected["x.5"] = np.nan
    same(correlate.corr_pearson(spark.createDataFrame(data).repartition(5)).collect(), expected)


def test_shuffle_does_not_grow_with_rows(spark, shuffled):
    def moved(rows):
        df = spark.range(0, rows, 1, 4).selectExpr(*[f"sin(id * {i + 1}) AS x{i}" for i in range(40)])
        found = correlate.corr_pearson(df)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
        return shuffled(lambda: found.write.format("noop").mode("overwrite").save())
    few, many = moved(400), moved(40_000)
    assert few > 0 and many < 1.2 * few


def test_infinite_values_and_empty_table(spark):
    data = frame(60, 20)
    data.iloc[3, 0], data.iloc[4, 2] = np.inf, -np.inf
    got = {(r["var1"], r["var2"]): r["r"] for r in correlate.corr_pearson(spark.createDataFrame(data)).collect()}
    assert np.isnan(got["x.0", "x.3"]) and np.isnan(got["x.2", "x.3"]) and not np.isnan(got["x.3", "x.4"])
    empty = correlate.corr_pearson(spark.createDataFrame(data).limit(0)).collect()
    assert len(empty) == 190 and all(r["r"] is None for r in empty)


@pytest.mark.parametrize("lacking", [False, True])
def test_spearman(spark, lacking):
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.integers(0, 30, (200, 21)) * 1.0 + rng.normal(size=(200, 1)) * 5, columns=[f"x{i}" for i in range(21)]).round(1)
    if lacking:
        data.iloc[rng.integers(0, 200, 40), 3] = np.nan
        data.iloc[rng.integers(0, 200, 40), 20] = np.nan
    same(correlate.corr_spearman(spark.createDataFrame(data).repartition(3)).collect(), by_pair(data))


@pytest.mark.parametrize("limit,joined", [(10_000, 32), (300, 32), (10_000, 3), (0, 32)])
def test_spearman_ranks_in_place(spark, shuffled, monkeypatch, limit, joined):
    """Columns of few values are ranked without leaving their row, the others by cells; the result is the same."""
    rng = np.random.default_rng(4)
    data = pd.DataFrame({f"x{i}": rng.integers(0, 10 * (i + 1), 400) * 1.0 if i % 6 else rng.normal(size=400) for i in range(18)})
    monkeypatch.setattr(correlate, "BROADCAST_VALUES", limit)
    monkeypatch.setattr(correlate, "MOST_JOINED", joined)
    same(correlate.corr_spearman(spark.createDataFrame(data).repartition(3)).collect(), by_pair(data))


def test_spearman_of_few_values_shuffles_no_rows(spark, shuffled):
    def moved(rows):
        df = spark.range(0, rows, 1, 4).selectExpr(*[f"id * {i + 1} % {i + 50} AS x{i}" for i in range(18)])
        return shuffled(lambda: correlate.corr_spearman(df).write.format("noop").mode("overwrite").save())
    assert moved(60_000) < 2 * moved(6_000)


def by_pair(data):
    out = pd.DataFrame(np.nan, data.columns, data.columns)
    for a in data:
        for b in data:
            both = data[[a, b]].dropna()
            out.loc[a, b] = both[a].rank().corr(both[b].rank()) if a != b else 1.0
    return out
