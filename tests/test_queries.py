"""Every registered query against its SQL, on the smallest tables."""

import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
OWN = [importlib.import_module(f"registry.{name}") for name in entry.MODULES]
QUERIES, SQL = ({k: v for m in OWN for k, v in getattr(m, kind).items()} for kind in ("QUERIES", "SQL"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(key, spark, duck):
    df = QUERIES[key](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"))
    if key not in SQL:
        assert rows
        return
    expected = duck.execute(SQL[key])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.columns, rows) == normal(names, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "l_returnflag"
