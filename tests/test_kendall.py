"""Kendall's tau-b: tasks get a bounded number of rows, whatever holds more values, and the result is that of all pairs."""

import numpy as np
import pandas as pd
import pytest

from tableglass.operators import correlate


def tau(x, y):
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


def largest_task(spark, action):
    """The most memory that operators of one task took, in MB."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()) for s in (found.apply(i) for i in range(found.size()))}
    before = stages()
    result = action()
    most = 0
    for stage, attempt in stages() - before:
        tasks = store.taskList(stage, attempt, 10_000)
        for t in (tasks.apply(i) for i in range(tasks.size())):
            if t.taskMetrics().isDefined():
                most = max(most, t.taskMetrics().get().peakExecutionMemory())
    return most / 1e6, result


@pytest.mark.parametrize("spans", [0, 2, 20])
def test_dealt_rows_give_all_pairs(spark, monkeypatch, spans):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"few": rng.integers(0, 5, 300) * 1.0, "hot": np.where(rng.random(300) < 0.6, 0.0, rng.normal(size=300)), "unlike": rng.normal(size=300)})
    data["near"] = (data["unlike"] + rng.normal(size=300)).round(1)
    monkeypatch.setattr(correlate, "BLOCK_BITS", 3)
    monkeypatch.setattr(correlate, "SPAN_BITS", spans)
    monkeypatch.setattr(correlate, "ROWS_PER_TASK", 100)
    got = {(r["var1"], r["var2"]): r["r"] for r in correlate.corr_kendall(spark.createDataFrame(data).repartition(3)).collect()}
    assert len(got) == 6
    for (a, b), r in got.items():
        assert r == pytest.approx(tau(data[a].to_numpy(), data[b].to_numpy()))


def test_memory_of_one_task(spark):
    """A pair with few and with many values: its rows don't meet in the task that made the ranks."""
    df = spark.range(0, 400_000, 1, 4).selectExpr("CAST(id * 31 % 50 AS DOUBLE) AS few", "CAST(id * 7919 % 400009 AS DOUBLE) AS many")
    most, rows = largest_task(spark, lambda: correlate.corr_kendall(df).collect())
    ids = np.arange(400_000, dtype=np.int64)
    few = (ids * 31 % 50)[np.argsort(ids * 7919 % 400_009)]
    # concordant less discordant pairs: of each row with the earlier ones of the other values
    up = sum((2 * (few > v) - 1.0)[few != v] @ np.cumsum(few == v)[few != v] for v in range(50))
    n0, ties = 400_000 * 399_999 / 2, 50 * 8_000 * 7_999 / 2
    assert rows[0]["r"] == pytest.approx(up / np.sqrt(n0 * (n0 - ties)))
    assert most < 800
