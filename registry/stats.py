"""Rows, ungrouped and grouped statistics."""

from pyspark.sql import functions as F

from registry import large, rounded, table, union
from tableglass.operators import rows, stats

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SKEWED = ["value"]


def lineitem(spark, folder):
    return table(spark, folder, "lineitem")


def orders(spark, folder):
    return table(spark, folder, "orders")


def events(spark, folder):
    return table(spark, folder, "events")


def with_nulls(spark, folder):
    """events whose value is missing for every seventh event."""
    return events(spark, folder).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


WITH_NULLS = """(SELECT event_id, ts, user_id, event_type, props,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events) t"""


def ungrouped(operation, digits=6):
    return lambda spark, folder: rounded(stats.stat(lineitem(spark, folder), NUMBERS, operation), digits)


def ungrouped_sql(operation, expression, digits=6):
    return union(NUMBERS, f"SELECT '{{c}}' AS \"column\", round({expression}, {digits}) AS \"{operation}\" FROM lineitem")


def grouped(operation, digits=6):
    return lambda spark, folder: rounded(
        stats.grouped_stat(lineitem(spark, folder), "l_extendedprice", operation, "l_returnflag"), digits)


def grouped_sql(operation, expression, digits=6):
    return (f"SELECT l_returnflag, round({expression.replace('{c}', 'l_extendedprice')}, {digits}) "
            f"AS {operation}_l_extendedprice FROM lineitem GROUP BY l_returnflag")


# operation, aggregate in SQL, decimal places (fewer where the numbers are large)
DOUBLES = {
    "mean": ("avg({c})", 6), "sum": ("coalesce(sum({c}), 0)", 2), "min": ("min({c})", 6), "max": ("max({c})", 6),
    "median": ("median({c})", 6), "std": ("stddev_samp({c})", 5), "variance": ("var_samp({c})", 2),
    "p25": ("quantile_cont({c}, 0.25)", 6), "p75": ("quantile_cont({c}, 0.75)", 6),
}

QUERIES = {
    # rows and columns
    "select_columns": lambda s, d: rows.select_columns(lineitem(s, d), ["l_orderkey", "l_extendedprice"]),
    "drop_column": lambda s, d: rows.drop_column(orders(s, d), "o_orderpriority"),
    "filter_compare": lambda s, d: rows.filter_compare(lineitem(s, d), "l_quantity", ">", 45.0),
    "filter_between": lambda s, d: rows.filter_between(lineitem(s, d), "l_discount", 0.02, 0.04),
    "datetime_to_epoch": lambda s, d: rows.datetime_to_epoch(orders(s, d), "o_orderdate").select(
        "o_orderkey", "o_orderdate_epoch"),
    "head": lambda s, d: rows.head(lineitem(s, d), ["l_orderkey", "l_linenumber", "l_partkey"], 10),
    "tail": lambda s, d: rows.tail(lineitem(s, d), ["l_orderkey", "l_linenumber", "l_partkey"], 10),
    "sample_rows": lambda s, d: rows.sample_rows(events(s, d), 10, seed=7, key="event_id"),
    "sort_rows": lambda s, d: rows.sort_rows(orders(s, d), "o_orderdate", ascending=False),
    # one statistic per column
    **{f"stat_{name}": ungrouped(name, digits) for name, (_, digits) in DOUBLES.items()},
    "stat_count": lambda s, d: stats.stat(with_nulls(s, d), ["event_id", "value", "event_type"], "count"),
    "stat_percentile": lambda s, d: rounded(stats.stat(lineitem(s, d), NUMBERS, "percentile", p=0.9)),
    "stat_all": lambda s, d: rounded(stats.stat(lineitem(s, d), NUMBERS), 5),
    "stat_dates": lambda s, d: stats.stat(orders(s, d), ["o_orderdate"], "min").unionAll(
        stats.stat(orders(s, d), ["o_orderdate"], "max")).unionAll(
        stats.stat(orders(s, d), ["o_orderdate"], "median")).withColumnRenamed("min", "date"),
    "quick_stats_numeric": lambda s, d: rounded(stats.quick_stats_numeric(with_nulls(s, d), ["value", "user_id"]), 5),
    "quick_stats_categorical": lambda s, d: stats.quick_stats_categorical(events(s, d), "event_type").select(
        "column", "unique", "mode", "null_count", "null_pct", F.inline("top_5")),
    "stat_skewness": lambda s, d: rounded(stats.stat(with_nulls(s, d), ["value", "user_id"], "skewness")),
    "stat_kurtosis": lambda s, d: rounded(stats.stat(with_nulls(s, d), ["value", "user_id"], "kurtosis")),
    "stat_mode": lambda s, d: stats.stat_mode(lineitem(s, d), NUMBERS),
    "stat_nunique": lambda s, d: stats.stat_nunique(lineitem(s, d), ["l_orderkey", "l_quantity", "l_shipdate"]),
    "null_counts": lambda s, d: rounded(stats.null_counts(with_nulls(s, d))),
    "value_counts": lambda s, d: stats.value_counts(lineitem(s, d), "l_quantity"),
    # per group
    **{f"grouped_{name}": grouped(name, digits) for name, (_, digits) in DOUBLES.items()},
    "grouped_count": lambda s, d: stats.grouped_stat(with_nulls(s, d), "value", "count", "event_type"),
    "grouped_all": lambda s, d: rounded(stats.grouped_all(lineitem(s, d), "l_extendedprice", "l_returnflag"), 5, sum=2),
    "grouped_multi": lambda s, d: rounded(stats.grouped_stat(
        lineitem(s, d), ["l_quantity", "l_extendedprice", "l_discount"], "mean", "l_linestatus")),
    "stat_all_large": large(lambda s, d: rounded(stats.stat(lineitem(s, d), NUMBERS), 5)),
    "grouped_median_large": large(grouped("median", DOUBLES["median"][1])),
    "grouped_median_many_groups": lambda s, d: rounded(stats.grouped_stat(
        lineitem(s, d), ["l_quantity", "l_extendedprice"], "median", "l_orderkey")),
}

SQL = {
    "sample_rows": "SELECT * FROM events ORDER BY md5(concat_ws('|', '7', event_id)), event_id LIMIT 10",
    "select_columns": "SELECT l_orderkey, l_extendedprice FROM lineitem",
    "drop_column": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
    "filter_compare": "SELECT * FROM lineitem WHERE l_quantity > 45.0",
    "filter_between": "SELECT * FROM lineitem WHERE l_discount BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.04 AS DOUBLE)",
    "datetime_to_epoch": "SELECT o_orderkey, epoch_us(o_orderdate) AS o_orderdate_epoch FROM orders",
    "head": "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 10",
    "tail": "SELECT * FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC LIMIT 10",
    "sort_rows": "SELECT * FROM orders ORDER BY o_orderdate DESC",
    **{f"stat_{name}": ungrouped_sql(name, expression, digits) for name, (expression, digits) in DOUBLES.items()},
    "stat_count": union(["event_id", "value", "event_type"],
                        f"SELECT '{{c}}' AS \"column\", count({{c}}) AS \"count\" FROM {WITH_NULLS}"),
    "stat_percentile": ungrouped_sql("percentile", "quantile_cont({c}, 0.9)"),
    "stat_all": union(NUMBERS, """SELECT '{c}' AS "column", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std,
      round(min({c}), 5) AS min, round(max({c}), 5) AS max, round(median({c}), 5) AS median, count({c}) AS "count"
      FROM lineitem"""),
    "stat_dates": """SELECT 'o_orderdate' AS "column", min(o_orderdate) AS date FROM orders UNION ALL
      SELECT 'o_orderdate', max(o_orderdate) FROM orders UNION ALL SELECT 'o_orderdate', median(o_orderdate) FROM orders""",
    "quick_stats_numeric": union(["value", "user_id"], f"""SELECT '{{c}}' AS "column", count({{c}}) AS "count",
      round(avg({{c}}), 5) AS mean, round(stddev_samp({{c}}), 5) AS std, round(CAST(min({{c}}) AS DOUBLE), 5) AS min,
      round(quantile_cont({{c}}, 0.25), 5) AS p25, round(median({{c}}), 5) AS median,
      round(quantile_cont({{c}}, 0.75), 5) AS p75, round(CAST(max({{c}}) AS DOUBLE), 5) AS max,
      count(*) - count({{c}}) AS null_count,
      round(100.0 * (count(*) - count({{c}})) / CAST(count(*) AS DOUBLE), 5) AS null_pct,
      round(skewness({{c}}), 5) AS skewness, round(kurtosis({{c}}), 5) AS kurtosis FROM {WITH_NULLS}"""),
    "quick_stats_categorical": """WITH c AS (SELECT event_type AS value, count(*) AS "count" FROM events
        WHERE event_type IS NOT NULL GROUP BY 1)
      SELECT 'event_type' AS "column", (SELECT count(*) FROM c) AS "unique",
        (SELECT value FROM c ORDER BY "count" DESC, value LIMIT 1) AS mode,
        (SELECT count(*) - count(event_type) FROM events) AS null_count,
        (SELECT 100.0 * (count(*) - count(event_type)) / CAST(count(*) AS DOUBLE) FROM events) AS null_pct,
        value, "count" FROM (SELECT * FROM c ORDER BY "count" DESC, value LIMIT 5)""",
    "stat_skewness": union(["value", "user_id"],
                           f"SELECT '{{c}}' AS \"column\", round(skewness({{c}}), 6) AS skewness FROM {WITH_NULLS}"),
    "stat_kurtosis": union(["value", "user_id"],
                           f"SELECT '{{c}}' AS \"column\", round(kurtosis({{c}}), 6) AS kurtosis FROM {WITH_NULLS}"),
    "stat_mode": union(NUMBERS, """SELECT '{c}' AS "column", (SELECT {c} FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}
      ORDER BY count(*) DESC, {c} LIMIT 1) AS mode"""),
    "stat_nunique": union(["l_orderkey", "l_quantity", "l_shipdate"],
                          "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM lineitem"),
    "null_counts": union(["event_id", "ts", "user_id", "event_type", "value", "props"], f"""SELECT '{{c}}' AS "column",
      count(*) - count({{c}}) AS null_count,
      round(100.0 * (count(*) - count({{c}})) / CAST(count(*) AS DOUBLE), 6) AS null_pct FROM {WITH_NULLS}"""),
    "value_counts": "SELECT l_quantity, count(*) AS \"count\" FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1",
    **{f"grouped_{name}": grouped_sql(name, expression, digits) for name, (expression, digits) in DOUBLES.items()},
    "grouped_count": f"SELECT event_type, count(value) AS count_value FROM {WITH_NULLS} GROUP BY 1",
    "grouped_all": """SELECT l_returnflag, round(avg(l_extendedprice), 5) AS mean, round(sum(l_extendedprice), 2) AS sum,
      round(min(l_extendedprice), 5) AS min, round(max(l_extendedprice), 5) AS max,
      round(median(l_extendedprice), 5) AS median, round(stddev_samp(l_extendedprice), 5) AS std,
      count(l_extendedprice) AS "count" FROM lineitem GROUP BY 1""",
    "grouped_multi": """SELECT l_linestatus, round(avg(l_quantity), 6) AS mean_l_quantity,
      round(avg(l_extendedprice), 6) AS mean_l_extendedprice, round(avg(l_discount), 6) AS mean_l_discount
      FROM lineitem GROUP BY 1""",
    "grouped_median_many_groups": """SELECT l_orderkey, round(median(l_quantity), 6) AS median_l_quantity,
      round(median(l_extendedprice), 6) AS median_l_extendedprice FROM lineitem GROUP BY 1""",
}

SQL |= {"stat_all_large": SQL["stat_all"], "grouped_median_large": SQL["grouped_median"]}
