"""Chart tables."""

from pyspark.sql import functions as F

from registry import large, rounded, table
from registry.stats import WITH_NULLS, with_nulls
from tableglass.operators import charts
from tableglass.operators.stats import value_counts
from tableglass.plans.quantiles import quantiles_by_counting


def lineitem(s, d):
    return table(s, d, "lineitem")


def orders(s, d):
    return table(s, d, "orders")


def events(s, d):
    return table(s, d, "events")


BIN = """CASE WHEN hi > lo THEN CAST(least(floor(({c} - lo) / (hi - lo) * {n}) + 1, {n}) AS INTEGER) ELSE 1 END"""


def bin_of(column, bins):
    return BIN.replace("{c}", column).replace("{n}", str(bins))


def edges(column, of):
    return f"(SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {of})"


LOWER = "round(lo + (hi - lo) / CAST({n} AS DOUBLE) * (bin - 1), 6) AS lower"
UPPER = "round(CASE WHEN bin = {n} THEN hi ELSE lo + (hi - lo) / CAST({n} AS DOUBLE) * bin END, 6) AS upper"


def top(column, n, of, name="count"):
    return f"""SELECT {column}, count(*) AS "{name}" FROM {of} WHERE {column} IS NOT NULL GROUP BY 1
      ORDER BY count(*) DESC, 1 LIMIT {n}"""


def box_sql(y, by, of):
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    keep = f"WHERE {y} IS NOT NULL" + (f" AND {by} IS NOT NULL" if by else "")
    quartiles = f"""SELECT {group}{y} AS y, quantile_cont({y}, CAST(0.25 AS DOUBLE)) OVER ({part}) AS q1, quantile_cont({y}, CAST(0.5 AS DOUBLE)) OVER ({part}) AS median,
      quantile_cont({y}, CAST(0.75 AS DOUBLE)) OVER ({part}) AS q3 FROM {of} {keep}"""
    return f"""SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM ({quartiles})"""


def box_summary_sql(y, by, of):
    group = f"{by}, " if by else ""
    return f"""SELECT {group}round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3,
      round(min(y) FILTER (WHERE y BETWEEN lower AND upper), 6) AS whisker_low,
      round(max(y) FILTER (WHERE y BETWEEN lower AND upper), 6) AS whisker_high,
      count(*) AS n, count(*) FILTER (WHERE y NOT BETWEEN lower AND upper) AS outliers
      FROM ({box_sql(y, by, of)}) {"GROUP BY " + by if by else ""}"""


def violin_sql(y, by, of, grid, bins):
    """``by``: the group columns, with commas between; a group without spread has one point without density."""
    group = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    return f"""WITH v AS (SELECT {group}{y} AS y FROM {of} WHERE {y} IS NOT NULL),
      s0 AS (SELECT {group}min(y) AS lo, max(y) AS hi, stddev_samp(y) AS sd, CAST(count(*) AS DOUBLE) AS n,
        quantile_cont(y, CAST(0.75 AS DOUBLE)) - quantile_cont(y, CAST(0.25 AS DOUBLE)) AS iqr FROM v {g}),
      s1 AS (SELECT {group}lo, hi, n, CAST(0.9 AS DOUBLE) * CASE WHEN iqr > 0 THEN least(sd, iqr / CAST(1.34 AS DOUBLE)) ELSE sd END
        * pow(n, CAST(-0.2 AS DOUBLE)) AS h FROM s0),
      s AS (SELECT * FROM s1 WHERE lo < hi),
      b AS (SELECT {group}lo, hi, n, h, {bin_of('y', bins)} AS bin, count(*) AS cnt FROM v JOIN s {join} GROUP BY ALL),
      c AS (SELECT *, lo + (bin - CAST(0.5 AS DOUBLE)) * (hi - lo) / CAST({bins} AS DOUBLE) AS centre FROM b),
      p AS (SELECT *, unnest(generate_series(0, {grid - 1})) AS point FROM c),
      q AS (SELECT *, lo - 2 * h + point * ((hi + 2 * h) - (lo - 2 * h)) / CAST({grid - 1} AS DOUBLE) AS "at" FROM p)
      SELECT {group}CAST(point AS INTEGER) AS point, round(max("at"), 5) AS "at",
        round(sum(cnt * exp(-0.5 * (("at" - centre) / h) * (("at" - centre) / h)) / (n * h * sqrt(2 * pi()))), 9) AS density
      FROM q GROUP BY {group}point
      UNION ALL SELECT {group}CAST(0 AS INTEGER), round(lo, 5), NULL FROM s1 WHERE lo = hi"""


GROUPS = """(SELECT value, CASE WHEN event_id = 5 THEN 'lonely' WHEN event_id % 50 = 7 THEN 'same' ELSE event_type END AS kind,
  CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS side FROM (SELECT event_id, event_type, CASE WHEN event_id % 50 = 7 THEN 1.5 ELSE value END AS value FROM events)) g"""


def grouped_events(s, d):
    """Events with a group of one row and one of equal values."""
    e, i = events(s, d), F.col("event_id")
    return e.select(
        F.when(i % 50 == 7, 1.5).otherwise(F.col("value")).alias("value"),
        F.when(i == 5, "lonely").when(i % 50 == 7, "same").otherwise(F.col("event_type")).alias("kind"),
        F.when(i % 3 == 0, "a").otherwise("b").alias("side"))


def named(s, d):
    """Events with columns that have the names of results."""
    return events(s, d).select(F.col("user_id").alias("count"), F.col("event_type").alias("n"), F.col("value").alias("y"))


def line_points_sql(x, y, color, place, n, of):
    """In each of n equal parts of x (and colour) the first, last, lowest and highest point."""
    by = f"{color}, bin" if color else "bin"
    ends = " UNION ".join(f"SELECT {color + ', ' if color else ''}{x}, {y} FROM p QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}) = 1" for order in (
        f"{x}, {y}", f"{x} DESC, {y} DESC", f"{y}, {x}", f"{y} DESC, {x} DESC"))
    return f"""WITH e AS (SELECT min({place}) AS lo, max({place}) AS hi FROM {of}),
      p AS (SELECT *, least(floor(({place} - lo) / (hi - lo) * {n}.0e0) + 1, {n}) AS bin FROM {of}, e) {ends}"""


QUERIES = {
    "hist_numeric": lambda s, d: rounded(charts.hist_numeric(lineitem(s, d), "l_extendedprice")),
    "hist_empty_bins": lambda s, d: rounded(charts.hist_numeric(with_nulls(s, d), "value", 200)),
    "hist_by": lambda s, d: rounded(charts.hist_by(lineitem(s, d), "l_extendedprice", "l_returnflag", 20)),
    "hist_marginal_box": lambda s, d: rounded(charts.hist_marginal_box(events(s, d), "value")),
    "freq_top": lambda s, d: charts.freq_top(events(s, d), "user_id", 30),
    "bar_sum_top": lambda s, d: rounded(charts.bar_sum_top(orders(s, d), "o_totalprice", "o_custkey", 20), 2),
    "bar_sum": lambda s, d: rounded(charts.bar_sum(orders(s, d), "o_orderpriority", "o_totalprice", "o_orderstatus"), 2),
    "bar_count_top": lambda s, d: charts.bar_count_top(lineitem(s, d), "l_shipdate", 15),
    "bar_first_rows": lambda s, d: charts.bar_first_rows(orders(s, d), "o_totalprice", "o_orderkey", 50),
    "scatter_points": lambda s, d: charts.scatter_points(with_nulls(s, d), "user_id", "value", "event_type"),
    "scatter_sample": lambda s, d: charts.scatter_sample(
        lineitem(s, d), "l_quantity", "l_extendedprice", "l_returnflag", 5000, key=["l_orderkey", "l_linenumber"]),
    "line_mean_by": lambda s, d: rounded(charts.line_mean_by(lineitem(s, d), "l_extendedprice", "l_shipdate")),
    "line_raw": lambda s, d: charts.line_raw(orders(s, d), "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderkey"),
    "line_auto": lambda s, d: rounded(charts.line_auto(orders(s, d), "o_orderdate", "o_totalprice"), 5),
    "line_auto_raw": lambda s, d: charts.line_auto(
        orders(s, d), "o_orderdate", "o_totalprice", "o_orderstatus", aggregate=False, order_by="o_orderkey", max_points=None),
    "line_auto_points": lambda s, d: charts.line_auto(events(s, d), "ts", "value", "event_type", aggregate=False, max_points=50),
    "line_points_numbers": lambda s, d: charts.line_points(lineitem(s, d), "l_extendedprice", "l_quantity", max_points=1000),
    "value_counts_named_count": lambda s, d: value_counts(named(s, d), "count", 20),
    "box_summary_named_n": lambda s, d: rounded(charts.box_summary(named(s, d), "y", "n")),
    "violin_density_groups": lambda s, d: rounded(charts.violin_density(grouped_events(s, d), "value", "kind", "side"), 5, density=9),
    "pie_share": lambda s, d: rounded(charts.pie_share(lineitem(s, d), "l_shipdate", 10)),
    "box_summary": lambda s, d: rounded(charts.box_summary(with_nulls(s, d), "value", "event_type")),
    "box_outlier_points": lambda s, d: charts.box_outlier_points(events(s, d), "value", "event_type"),
    "area_series": lambda s, d: rounded(charts.area_series(orders(s, d), "o_orderdate", "o_totalprice", "o_orderpriority"), 2),
    "violin_density": lambda s, d: rounded(charts.violin_density(events(s, d), "value", "event_type"), 5, density=9),
    "violin_density_whole": lambda s, d: rounded(charts.violin_density(events(s, d), "value", grid=50, bins=256), 5, density=9),
    "box_summary_large": large(lambda s, d: rounded(charts.box_summary(with_nulls(s, d), "value", "event_type"))),
    "violin_density_large": large(lambda s, d: rounded(charts.violin_density(grouped_events(s, d), "value", "kind", "side"), 5, density=9)),
    # the counting form of the exact quantiles, which large tables take
    "quantiles_by_counting": lambda s, d: rounded(quantiles_by_counting(
        lineitem(s, d), ["l_extendedprice", "l_quantity", "l_partkey"], [0.01, 0.25, 0.5, 0.75, 0.99])),
    "quantiles_by_counting_grouped": lambda s, d: rounded(quantiles_by_counting(
        lineitem(s, d), ["l_extendedprice", "l_tax"], [0.25, 0.5, 0.9], ["l_returnflag", "l_linestatus"])),
}

P = [0.01, 0.25, 0.5, 0.75, 0.99]

SQL = {
    "hist_numeric": f"""WITH e AS {edges('l_extendedprice', 'lineitem')}, c AS (
        SELECT {bin_of('l_extendedprice', 30)} AS bin, count(*) AS n FROM lineitem, e GROUP BY 1),
      b AS (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS bin)
      SELECT bin, {LOWER.replace('{n}', '30')}, {UPPER.replace('{n}', '30')}, coalesce(n, 0) AS "count"
      FROM b CROSS JOIN e LEFT JOIN c USING (bin)""",
    "hist_empty_bins": f"""WITH e AS {edges('value', WITH_NULLS)}, c AS (
        SELECT {bin_of('value', 200)} AS bin, count(*) AS n FROM {WITH_NULLS}, e WHERE value IS NOT NULL GROUP BY 1),
      b AS (SELECT CAST(unnest(generate_series(1, 200)) AS INTEGER) AS bin)
      SELECT bin, {LOWER.replace('{n}', '200')}, {UPPER.replace('{n}', '200')}, coalesce(n, 0) AS "count"
      FROM b CROSS JOIN e LEFT JOIN c USING (bin)""",
    "hist_by": f"""WITH e AS {edges('l_extendedprice', 'lineitem')}
      SELECT l_returnflag, bin, {LOWER.replace('{n}', '20')}, {UPPER.replace('{n}', '20')}, "count" FROM e, (
        SELECT l_returnflag, {bin_of('l_extendedprice', 20)} AS bin, count(*) AS "count" FROM lineitem, e GROUP BY 1, 2)""",
    "hist_marginal_box": box_summary_sql("value", None, "events"),
    "freq_top": top("user_id", 30, "events"),
    "bar_sum_top": """SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1
      ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20""",
    "bar_sum": """SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2""",
    "bar_count_top": top("l_shipdate", 15, "lineitem"),
    "bar_first_rows": """SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS position, o_totalprice FROM
      (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)""",
    "scatter_points": f"SELECT user_id, value, event_type FROM {WITH_NULLS} WHERE value IS NOT NULL",
    "line_mean_by": """SELECT l_shipdate, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY 1""",
    "line_raw": "SELECT o_orderdate, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderdate",
    "line_auto": "SELECT o_orderdate, round(avg(o_totalprice), 5) AS o_totalprice FROM orders GROUP BY 1",
    "scatter_sample": """SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
      ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber)), l_orderkey, l_linenumber LIMIT 5000""",
    "line_auto_points": line_points_sql("ts", "value", "event_type", "CAST(epoch_us(ts) AS DOUBLE)", 50, "events"),
    "line_points_numbers": line_points_sql("l_extendedprice", "l_quantity", None, "l_extendedprice", 1000, "lineitem"),
    "line_auto_raw": "SELECT o_orderdate, o_totalprice, o_orderstatus FROM orders",
    "value_counts_named_count": """SELECT user_id AS "count", count(*) AS count_ FROM events WHERE user_id IS NOT NULL GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 20""",
    "box_summary_named_n": f"""SELECT event_type AS n, * EXCLUDE (event_type, n), n AS n_ FROM ({box_summary_sql("value", "event_type", "events")})""",
    "violin_density_groups": violin_sql("value", "kind, side", GROUPS, 100, 512),
    "pie_share": f"""SELECT l_shipdate, "count", round("count" / CAST(sum("count") OVER () AS DOUBLE), 6) AS share
      FROM ({top('l_shipdate', 10, 'lineitem')})""",
    "box_summary": box_summary_sql("value", "event_type", WITH_NULLS),
    "box_outlier_points": f"""SELECT event_type, y AS value FROM ({box_sql('value', 'event_type', 'events')})
      WHERE y NOT BETWEEN lower AND upper""",
    "area_series": """WITH g AS (SELECT o_orderdate, o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
      SELECT o_orderdate, o_orderpriority, round(v, 2) AS o_totalprice,
        round(sum(v) OVER (PARTITION BY o_orderdate ORDER BY o_orderpriority), 2) AS top FROM g""",
    "violin_density": violin_sql("value", "event_type", "events", 100, 512),
    "violin_density_whole": violin_sql("value", None, "events", 50, 256),
    "quantiles_by_counting": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS p, count({c}) AS n,
        round(quantile_cont({c}, CAST({p} AS DOUBLE)), 6) AS quantile FROM lineitem"""
        for c in ("l_extendedprice", "l_quantity", "l_partkey") for p in P),
    "quantiles_by_counting_grouped": " UNION ALL ".join(
        f"""SELECT l_returnflag, l_linestatus, '{c}' AS "column", CAST({p} AS DOUBLE) AS p, count({c}) AS n,
        round(quantile_cont({c}, CAST({p} AS DOUBLE)), 6) AS quantile FROM lineitem GROUP BY 1, 2"""
        for c in ("l_extendedprice", "l_tax") for p in (0.25, 0.5, 0.9)),
}

SQL |= {"box_summary_large": SQL["box_summary"], "violin_density_large": SQL["violin_density_groups"]}
