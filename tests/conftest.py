import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def counting(spark):
    """Exact quantiles as large tables take them, whatever the size."""
    spark.conf.set("tableglass.quantiles.bufferRows", "0")
    yield
    spark.conf.unset("tableglass.quantiles.bufferRows")


@pytest.fixture
def shuffled(spark):
    """Bytes that an action shuffles."""
    def measured(action):
        sc = spark.sparkContext._jsc.sc()

        def total():
            sc.listenerBus().waitUntilEmpty(30_000)
            executors = sc.statusStore().executorList(True)
            return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))
        before = total()
        action()
        return total() - before
    return measured
