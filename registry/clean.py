"""Cleaning operations and a pipeline of them."""

from pyspark.sql import functions as F

from registry import rounded, table
from registry.profile import LABELLED, labelled
from registry.stats import WITH_NULLS, with_nulls
from tableglass.operators import clean


def gaps(s, d):
    """events with the value missing for every seventh event and the type for every fifth."""
    return with_nulls(s, d).withColumn("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))


GAPS = f"""(SELECT event_id, ts, user_id, props, value,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM {WITH_NULLS}) g"""
MODE = f"(SELECT event_type FROM {GAPS} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

STEPS = [
    {"type": "drop_column", "column": "event_id"},
    {"type": "drop_column", "column": "ts"},
    {"type": "drop_column", "column": "absent"},
    {"type": "drop_column", "column": "props"},
    {"type": "fill_missing", "column": "event_type", "method": "mode"},
    {"type": "remove_duplicates"},
    {"type": "fill_missing", "column": "value", "method": "mean"},
]
BEFORE = f"(SELECT user_id, value, coalesce(event_type, {MODE}) AS event_type FROM {GAPS})"
AFTER = f"(SELECT DISTINCT * FROM {BEFORE})"


def step(number, kind, column="NULL", method="NULL", before="NULL", after="NULL", filled="NULL"):
    return f"""SELECT {number} AS step, '{kind}' AS type, CAST({column} AS VARCHAR) AS "column", CAST({method} AS VARCHAR) AS method,
      CAST({before} AS BIGINT) AS rows_before, CAST({after} AS BIGINT) AS rows_after,
      CAST({before} AS BIGINT) - CAST({after} AS BIGINT) AS rows_removed, CAST({filled} AS BIGINT) AS filled"""


QUERIES = {
    "remove_duplicates_wide": lambda s, d: clean.remove_duplicates(table(s, d, "lineitem").unionAll(table(s, d, "lineitem").filter("l_orderkey % 100 = 7"))),
    "remove_duplicates": lambda s, d: clean.remove_duplicates(table(s, d, "events").select("user_id", "event_type")),
    "fill_mean": lambda s, d: rounded(clean.fill_mean(gaps(s, d), "value").select("event_id", "value")),
    "fill_median": lambda s, d: rounded(clean.fill_median(gaps(s, d), "value").select("event_id", "value")),
    "fill_mode": lambda s, d: clean.fill_mode(gaps(s, d), "event_type").select("event_id", "event_type"),
    "fill_constant": lambda s, d: clean.fill_constant(gaps(s, d), "event_type").select("event_id", "event_type"),
    "fill_integer_mean": lambda s, d: rounded(clean.fill_mean(labelled(s, d), "quality").select("doc_id", "quality")),
    "clean_operations": lambda s, d: rounded(clean.clean_pipeline(gaps(s, d), STEPS)[0]),
    "clean_operations_report": lambda s, d: clean.clean_pipeline(gaps(s, d), STEPS)[1],
}

SQL = {
    "remove_duplicates_wide": "SELECT DISTINCT * FROM lineitem",
    "remove_duplicates": "SELECT DISTINCT user_id, event_type FROM events",
    "fill_mean": f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {GAPS})), 6) AS value FROM {GAPS}",
    "fill_median": f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {GAPS})), 6) AS value FROM {GAPS}",
    "fill_mode": f"SELECT event_id, coalesce(event_type, {MODE}) AS event_type FROM {GAPS}",
    "fill_constant": f"SELECT event_id, coalesce(event_type, 'UNKNOWN') AS event_type FROM {GAPS}",
    "fill_integer_mean": f"""SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM {LABELLED})), 6) AS quality
      FROM {LABELLED}""",
    "clean_operations": f"""SELECT user_id, event_type, round(coalesce(value, (SELECT avg(value) FROM {AFTER})), 6) AS value
      FROM {AFTER}""",
    "clean_operations_report": " UNION ALL ".join([
        step(1, "drop_column", "'event_id'"), step(2, "drop_column", "'ts'"), step(4, "drop_column", "'props'"),
        step(5, "fill_missing", "'event_type'", "'mode'",
             filled=f"(SELECT count(*) - count(event_type) FROM {GAPS})"),
        step(6, "remove_duplicates", before=f"(SELECT count(*) FROM {BEFORE})", after=f"(SELECT count(*) FROM {AFTER})"),
        step(7, "fill_missing", "'value'", "'mean'", filled=f"(SELECT count(*) - count(value) FROM {AFTER})")]),
}
