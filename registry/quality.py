"""Missing values, duplicates, outliers, rules."""

from pyspark.sql import functions as F

from registry import large, rounded, table, union
from registry.profile import LABELLED, WARNED, labelled
from registry.stats import WITH_NULLS, with_nulls
from tableglass.operators import quality


def repeated(s, d):
    """lineitem without its keys: many identical rows."""
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax")


def pairs(s, d):
    return table(s, d, "events").select("user_id", "event_type")


def measured(s, d):
    """documents' lengths and labels: outliers in one column, missing values in others."""
    return labelled(s, d).select("doc_id", "n_chars", "quality")


COLUMNS4 = "l_returnflag, l_linestatus, l_discount, l_tax"
FENCES = """SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM
  (SELECT quantile_cont({c}, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont({c}, CAST(0.75 AS DOUBLE)) AS q3 FROM {t})"""


def fences(column, of):
    return FENCES.replace("{c}", column).replace("{t}", of)


VALUE = fences("value", "events")
MISSING = f"""SELECT * FROM ({union(WARNED, f'''SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS missing, count(*) AS n,
  '{{c}}' IN ('text', 'lang', 'source') AS is_text, abs(skewness(CASE WHEN '{{c}}' IN ('text', 'lang', 'source') THEN NULL ELSE
  TRY_CAST({{c}} AS DOUBLE) END)) AS skew FROM {LABELLED}''')}) WHERE missing > 0"""


def outlier_sql(select):
    """Over the numeric columns of ``measured`` with an outlier."""
    parts = [f"""SELECT '{c}' AS "column", count(*) AS n, count({c}) AS present,
        count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS outliers, max(lower) AS lower, max(upper) AS upper,
        CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
        CAST(min({c}) FILTER (WHERE {c} < lower OR {c} > upper) AS DOUBLE) AS low,
        CAST(max({c}) FILTER (WHERE {c} < lower OR {c} > upper) AS DOUBLE) AS high
      FROM {LABELLED}, ({fences(c, LABELLED)}) f""" for c in ("doc_id", "n_chars", "quality")]
    return f"SELECT {select} FROM ({' UNION ALL '.join(parts)}) WHERE present >= 10 AND outliers > 0"


def wide_repeated(s, d):
    """Whole line items, those of every hundredth order twice."""
    items = table(s, d, "lineitem")
    return items.unionAll(items.filter("l_orderkey % 100 = 7"))


QUERIES = {
    "outliers_iqr_all_large": large(lambda s, d: quality.outliers_iqr_all(measured(s, d))),
    "missing_report": lambda s, d: quality.missing_report(labelled(s, d)),
    "missing_recommendations": lambda s, d: quality.missing_recommendations(labelled(s, d)),
    "missing_recommendations_skewed": lambda s, d: quality.missing_recommendations(with_nulls(s, d)),
    "duplicate_count": lambda s, d: quality.duplicate_count(repeated(s, d)),
    "duplicate_rows": lambda s, d: quality.duplicate_rows(repeated(s, d), 10),
    "duplicate_count_wide": lambda s, d: quality.duplicate_count(wide_repeated(s, d)),
    "duplicate_rows_wide": lambda s, d: quality.duplicate_rows(wide_repeated(s, d), 10),
    "key_candidate_duplicates": lambda s, d: quality.key_candidate_duplicates(
        table(s, d, "lineitem").select("l_returnflag", "l_shipdate", "l_partkey", "l_orderkey")).select(
        F.concat_ws(",", "columns").alias("columns"), "duplicates"),
    "outliers_iqr": lambda s, d: rounded(quality.outliers_iqr(table(s, d, "events"), "value")),
    "outliers_iqr_all": lambda s, d: quality.outliers_iqr_all(measured(s, d)),
    "outlier_extremes": lambda s, d: quality.outlier_extremes(measured(s, d)),
    "outlier_rows": lambda s, d: quality.outlier_rows(table(s, d, "events"), "value"),
    "outliers_zscore": lambda s, d: rounded(quality.outliers_zscore(with_nulls(s, d), "value").select(
        "event_id", "value", "zscore")),
    "quality_summary": lambda s, d: quality.quality_summary(measured(s, d)),
    "quality_rules": lambda s, d: rounded(quality.quality_rules(
        labelled(s, d), ["quality", "source", "n_chars"], by="doc_id")),
    "quality_rules_duplicates": lambda s, d: rounded(quality.quality_rules(
        repeated(s, d), ["l_discount", "l_returnflag"], by="l_linestatus")),
}

SQL = {
    "missing_report": f"""SELECT "column", CASE WHEN is_text THEN 'categorical' ELSE 'numeric' END AS "class", missing,
      round(100.0 * missing / CAST(n AS DOUBLE), 2) AS pct, CAST(sum(missing) OVER () AS BIGINT) AS total_missing,
      count(*) OVER () AS columns_affected FROM ({MISSING})""",
    "missing_recommendations": f"""SELECT "column", missing, CASE WHEN missing > 0.5 * n THEN 'drop_column'
      WHEN is_text THEN 'fill_mode' WHEN skew > 1 THEN 'fill_median' ELSE 'fill_mean' END AS strategy FROM ({MISSING})""",
    "missing_recommendations_skewed": f"""SELECT 'value' AS "column", count(*) - count(value) AS missing,
      CASE WHEN abs(skewness(value)) > 1 THEN 'fill_median' ELSE 'fill_mean' END AS strategy FROM {WITH_NULLS}""",
    "duplicate_count": f"""SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
      round(100.0 * sum(n - 1) / CAST(sum(n) AS DOUBLE), 2) AS pct
      FROM (SELECT count(*) AS n FROM lineitem GROUP BY {COLUMNS4})""",
    "duplicate_rows": f"""SELECT {COLUMNS4} FROM (SELECT {COLUMNS4}, count(*) OVER (PARTITION BY {COLUMNS4}) AS n FROM lineitem)
      WHERE n > 1 ORDER BY {COLUMNS4} LIMIT 10""",
    "duplicate_count_wide": """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
      round(100.0 * sum(n - 1) / CAST(sum(n) AS DOUBLE), 2) AS pct FROM (SELECT count(*) AS n FROM (
        SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 7) t GROUP BY t)""",
    "duplicate_rows_wide": """SELECT * EXCLUDE (n) FROM (SELECT *, 2 AS n FROM lineitem WHERE l_orderkey % 100 = 7 UNION ALL
      SELECT *, 2 FROM lineitem WHERE l_orderkey % 100 = 7) ORDER BY ALL LIMIT 10""",
    "key_candidate_duplicates": """SELECT * FROM (
      SELECT 'l_returnflag' AS columns, count(*) - count(DISTINCT l_returnflag) AS duplicates FROM lineitem UNION ALL
      SELECT 'l_returnflag,l_shipdate', count(*) - count(DISTINCT (l_returnflag, l_shipdate)) FROM lineitem UNION ALL
      SELECT 'l_returnflag,l_shipdate,l_partkey', count(*) - count(DISTINCT (l_returnflag, l_shipdate, l_partkey))
      FROM lineitem) WHERE duplicates > 0""",
    "outliers_iqr": f"""SELECT 'value' AS "column", round(max(lower), 6) AS lower, round(max(upper), 6) AS upper,
      count(*) FILTER (WHERE value < lower OR value > upper) AS outliers,
      round(100.0 * count(*) FILTER (WHERE value < lower OR value > upper) / CAST(count(*) AS DOUBLE), 6) AS pct,
      round(max(q1), 6) AS q1, round(max(q3), 6) AS q3, round(max(iqr), 6) AS iqr FROM events, ({VALUE}) f""",
    "outliers_iqr_all": outlier_sql("""\"column", outliers, round(100.0 * outliers / CAST(n AS DOUBLE), 2) AS pct,
      round(lower, 2) AS lower, round(upper, 2) AS upper"""),
    "outlier_extremes": outlier_sql("\"column\", lo AS min, hi AS max, low AS suspected_low, high AS suspected_high"),
    "outlier_rows": f"""SELECT event_id, ts, user_id, event_type, value, props FROM events, ({VALUE}) f
      WHERE value < lower OR value > upper""",
    "outliers_zscore": f"""SELECT event_id, round(value, 6) AS value, round(abs((value - m) / sd), 6) AS zscore FROM {WITH_NULLS},
      (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM {WITH_NULLS}) WHERE abs((value - m) / sd) > 3""",
    "quality_summary": f"""WITH o AS ({outlier_sql("*")}), d AS (SELECT count(*) AS n FROM {LABELLED} GROUP BY doc_id, n_chars, quality)
      , m AS (SELECT * FROM (SELECT 'table' AS issue, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {LABELLED}
      UNION ALL SELECT 'table', 'columns', 3.0
      UNION ALL SELECT 'missing', 'total_missing', CAST(count(*) - count(quality) AS DOUBLE) FROM {LABELLED}
      UNION ALL SELECT 'missing', 'columns_affected', 1.0
      UNION ALL SELECT 'duplicates', 'total_duplicates', CAST(sum(n - 1) AS DOUBLE) FROM d
      UNION ALL SELECT 'duplicates', 'percentage', round(100.0 * sum(n - 1) / CAST(sum(n) AS DOUBLE), 2) FROM d
      UNION ALL SELECT 'outliers', 'columns_analyzed', 3.0
      UNION ALL SELECT 'outliers', 'columns_with_outliers', CAST(count(*) AS DOUBLE) FROM o
      UNION ALL SELECT 'outliers', 'total_outliers', CAST(coalesce(sum(outliers), 0) AS DOUBLE) FROM o))
      SELECT issue, metric, CAST(value AS DOUBLE) AS value FROM m UNION ALL SELECT 'table', 'issues_found',
      CAST(count(*) FILTER (WHERE value > 0) AS DOUBLE) FROM m
      WHERE metric IN ('total_missing', 'total_duplicates', 'total_outliers')""",
    "quality_rules": f"""WITH f AS (SELECT count(*) AS n, 100.0 * (count(*) - count(quality)) / CAST(count(*) AS DOUBLE) AS q,
        count(*) - count(quality) + count(*) - count(toxic) AS nulls, count(DISTINCT quality) AS uq,
        count(DISTINCT source) AS us, count(DISTINCT n_chars) AS un, count(DISTINCT doc_id) AS ud FROM {LABELLED}),
      r AS (SELECT 'NO_MISSING' AS code, 'info' AS level, '*' AS "column", CAST(nulls AS DOUBLE) AS measure, nulls = 0 AS hit FROM f
      UNION ALL SELECT 'NO_DUPLICATES', 'info', '*', 0.0, n = ud FROM f
      UNION ALL SELECT 'TOO_SMALL_FOR_OUTLIERS', 'warning', '*', n, n < 10 FROM f
      UNION ALL SELECT 'TOO_MANY_MISSING', 'warning', 'quality', q, q > 50 FROM f
      UNION ALL SELECT 'CONSTANT_COLUMN', 'warning', 'quality', uq, uq = 1 FROM f
      UNION ALL SELECT 'CONSTANT_COLUMN', 'warning', 'n_chars', un, un = 1 FROM f
      UNION ALL SELECT 'TOO_MANY_CATEGORIES_HISTOGRAM', 'warning', 'source', us, us > 50 FROM f
      UNION ALL SELECT 'TOO_MANY_PIE_SLICES', 'warning', 'source', us, us > 10 FROM f
      UNION ALL SELECT 'CHAOTIC_LINE', 'warning', 'source', us, us > 100 FROM f
      UNION ALL SELECT 'DENSE_NUMERIC_GROUPS', 'warning', 'doc_id', ud, ud > 1000 FROM f
      UNION ALL SELECT 'TOO_MANY_GROUPS', 'warning', 'doc_id', ud, ud > 1000 FROM f
      UNION ALL SELECT 'SINGLE_GROUP', 'info', 'doc_id', ud, ud = 1 FROM f)
      SELECT code, level, "column", round(CAST(measure AS DOUBLE), 6) AS measure FROM r WHERE hit""",
    "quality_rules_duplicates": f"""WITH d AS (SELECT count(*) AS n FROM lineitem GROUP BY {COLUMNS4}),
      f AS (SELECT count(*) AS n, count(DISTINCT l_discount) AS ud, count(DISTINCT l_returnflag) AS ur,
        count(DISTINCT l_linestatus) AS ul, (SELECT sum(n - 1) FROM d) AS copies FROM lineitem),
      r AS (SELECT 'NO_MISSING' AS code, 'info' AS level, '*' AS "column", 0.0 AS measure, true AS hit FROM f
      UNION ALL SELECT 'NO_DUPLICATES', 'info', '*', copies, copies = 0 FROM f
      UNION ALL SELECT 'TOO_MANY_DUPLICATES', 'warning', '*', 100.0 * copies / CAST(n AS DOUBLE), copies > 0.5 * n FROM f
      UNION ALL SELECT 'CONSTANT_COLUMN', 'warning', 'l_discount', ud, ud = 1 FROM f
      UNION ALL SELECT 'TOO_MANY_PIE_SLICES', 'warning', 'l_returnflag', ur, ur > 10 FROM f
      UNION ALL SELECT 'SINGLE_GROUP', 'info', 'l_linestatus', ul, ul = 1 FROM f)
      SELECT code, level, "column", round(CAST(measure AS DOUBLE), 6) AS measure FROM r WHERE hit""",
}

SQL["outliers_iqr_all_large"] = SQL["outliers_iqr_all"]
