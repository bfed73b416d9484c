"""The registered queries of this package against their SQL on the smallest tables; the native one stays native."""

import duckdb
import pytest

from tableglass.llm.queries import QUERIES, SQL
from tools.check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("key", list(SQL))
def test_same_rows_as_sql(key, spark, duck):
    df = QUERIES[key](spark, FOLDER)
    expected = duck.execute(SQL[key])
    names = [d[0] for d in expected.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(names, expected.fetchall())


def test_native(spark):
    plan = QUERIES["op5_exact_dedup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in SQL and k != "pipeline"])
def test_a_row_for_each_input_row(key, spark):
    name = "pages" if key.startswith("op3") else "documents"
    assert QUERIES[key](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{name}.parquet").count()
