"""Reports and profiles."""

from pyspark.sql import functions as F

from registry import rounded, table, union
from registry.stats import WITH_NULLS, with_nulls
from tableglass.operators import profile
from tableglass.sources import infer

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
         "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
BYTES = {c: f"8 * count({c})" for c in ORDERS} | {
    c: f"CAST(sum(strlen({c})) AS BIGINT)" for c in ("o_orderstatus", "o_orderpriority")}
TEXTS = ["o_orderstatus", "o_orderpriority"]


def orders(s, d):
    return table(s, d, "orders")


def labelled(s, d):
    """documents with their labels, missing for most."""
    docs = table(s, d, "documents")
    return docs.join(table(s, d, "labels"), "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


LABELLED = "(SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) t"


def per_order_column(select):
    """One SELECT per column of orders; the function gives the SELECT list for a column."""
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {select(c)} FROM orders" for c in ORDERS)


def when_number(c, expression, other="CAST(NULL AS DOUBLE)"):
    return expression.replace("{c}", c) if TYPES[c] in ("bigint", "double") else other


def when_date(c, expression):
    return expression.replace("{c}", c) if TYPES[c] == "timestamp_ntz" else "CAST(NULL AS TIMESTAMP)"


def when_text(c, expression, null):
    return expression.replace("{c}", c) if TYPES[c] == "string" else f"CAST(NULL AS {null})"


def describe_select(c, digits=5):
    top = f"(SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    freq = f"(SELECT count(*) FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)"
    numbers = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "CAST(min({c}) AS DOUBLE)",
               "p25": "quantile_cont({c}, 0.25)", "p50": "quantile_cont({c}, 0.5)", "p75": "quantile_cont({c}, 0.75)",
               "max": "CAST(max({c}) AS DOUBLE)"}
    # the mean date to the second
    dates = {"dt_mean": "date_trunc('second', make_timestamp(CAST(round(avg(epoch_us({c}))) AS BIGINT)))",
             "dt_min": "min({c})", "dt_p25": "quantile_cont({c}, 0.25)", "dt_p50": "quantile_cont({c}, 0.5)",
             "dt_p75": "quantile_cont({c}, 0.75)", "dt_max": "max({c})"}
    parts = [f"count({c}) AS \"count\"", when_text(c, "count(DISTINCT {c})", "BIGINT") + ' AS "unique"',
             when_text(c, top, "VARCHAR") + " AS top", when_text(c, freq, "BIGINT") + " AS freq"]
    parts += [f"round({when_number(c, e)}, {digits}) AS {n}" for n, e in numbers.items()]
    parts += [f"{when_date(c, e)} AS {n}" for n, e in dates.items()]
    return ", ".join(parts)


def enriched_select(c):
    extra = {"cv": "stddev_samp({c}) / avg({c})", "skewness": "skewness({c})", "kurtosis": "kurtosis({c})",
             "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "range": "CAST(max({c}) - min({c}) AS DOUBLE)"}
    return describe_select(c, 4) + "".join(f", round({when_number(c, e)}, 4) AS \"{n}\"" for n, e in extra.items()) + \
        f", round(100.0 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE), 4) AS null_pct"


def to_the_second(df):
    return df.withColumn("dt_mean", F.date_trunc("second", "dt_mean").cast("timestamp_ntz"))


def numbers_select(c):
    return f"""SELECT '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), 5) AS min, round(CAST(max({c}) AS DOUBLE), 5) AS max,
      round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, count(*) FILTER (WHERE {c} = 0) AS zeros,
      count(*) FILTER (WHERE {c} < 0) AS negatives FROM """


def logical(c):
    if TYPES[c] == "timestamp_ntz":
        return "max('datetime')"
    if TYPES[c] != "string":
        return f"""CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary_numeric' WHEN count(DISTINCT {c}) > 20 THEN 'continuous'
          ELSE 'discrete' END"""
    return f"""CASE WHEN avg(CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'likely_date'
      WHEN avg(CASE WHEN contains({c}, '@') THEN 1.0 ELSE 0.0 END) > 0.3 THEN 'likely_email'
      WHEN avg(length({c})) > 100 THEN 'long_text' ELSE 'short_text' END"""


def suggested(c):
    if TYPES[c] == "bigint":
        return f"CASE WHEN max({c}) < 32767 THEN 'int32 or int16' ELSE 'int64' END"
    if TYPES[c] == "double":
        return f"CASE WHEN max({c}) < 1e38 THEN 'float32' ELSE 'float64' END"
    if TYPES[c] == "string":
        return f"CASE WHEN count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.5 THEN 'category' ELSE 'string' END"
    return f"max('{TYPES[c]}')"


def document_texts(s, d):
    """Text columns of several kinds: long, short, addresses and dates written out."""
    docs = table(s, d, "documents")
    return docs.select(
        "text", "lang", F.concat("source", F.lit("@"), "lang").alias("address"),
        F.date_format(F.timestamp_seconds(F.col("doc_id") * 86400), "yyyy-MM-dd").alias("day"))


WARNED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
TOP5 = """SELECT '{c}' AS "column", {c} AS value, count(*) AS "count",
  (SELECT count(DISTINCT {c}) = 2 FROM orders) AS is_boolean FROM orders WHERE {c} IS NOT NULL GROUP BY {c}
  QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= 5"""

QUERIES = {
    "describe_all": lambda s, d: rounded(to_the_second(profile.describe_all(orders(s, d))), 5),
    "describe_numeric": lambda s, d: rounded(profile.describe_numeric(table(s, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")), 5),
    "describe_enriched": lambda s, d: to_the_second(profile.describe_enriched(orders(s, d))),
    "profile_overview": lambda s, d: profile.profile_overview(orders(s, d)),
    "profile_columns": lambda s, d: profile.profile_columns(labelled(s, d)),
    "profile_numeric": lambda s, d: rounded(profile.profile_numeric(with_nulls(s, d)), 5),
    "profile_categorical": lambda s, d: profile.profile_categorical(orders(s, d)),
    "profile_warnings": lambda s, d: profile.profile_warnings(labelled(s, d)),
    "profile": lambda s, d: profile.profile(orders(s, d))["columns"],
    "profile_whole_overview": lambda s, d: profile.profile(orders(s, d))["overview"],
    "profile_whole_numeric": lambda s, d: rounded(profile.profile(with_nulls(s, d))["numeric"], 5),
    "profile_whole_categorical": lambda s, d: profile.profile(orders(s, d))["categorical"],
    "profile_whole_warnings": lambda s, d: profile.profile(labelled(s, d))["warnings"],
    "logical_types": lambda s, d: profile.logical_types(orders(s, d)),
    "logical_types_texts": lambda s, d: profile.logical_types(document_texts(s, d)),
    "suggest_types": lambda s, d: profile.suggest_types(orders(s, d)),
    "dtypes_report": lambda s, d: profile.dtypes_report(orders(s, d)),
    "column_classes": lambda s, d: profile.column_classes(orders(s, d)),
    "column_bytes": lambda s, d: profile.column_bytes(orders(s, d)),
    "column_info": lambda s, d: rounded(profile.column_info(orders(s, d)), 5),
    "detect_categorical": lambda s, d: rounded(profile.detect_categorical(orders(s, d))),
    "suggest_downcast": lambda s, d: infer.suggest_downcast(table(s, d, "lineitem")),
}

PROFILE_COLUMNS = per_order_column(lambda c: f"""'{TYPES[c]}' AS type, count(*) - count({c}) AS null_count,
  round(100.0 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE), 2) AS null_pct,
  count(DISTINCT {c}) AS unique_count, {BYTES[c]} AS bytes""")

SQL = {
    "describe_all": per_order_column(describe_select),
    "describe_numeric": union(["l_quantity", "l_extendedprice", "l_discount"], """SELECT '{c}' AS "column",
      count({c}) AS "count", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min,
      round(quantile_cont({c}, 0.25), 5) AS p25, round(quantile_cont({c}, 0.5), 5) AS p50,
      round(quantile_cont({c}, 0.75), 5) AS p75, round(max({c}), 5) AS max FROM lineitem"""),
    "describe_enriched": per_order_column(enriched_select),
    "profile_overview": f"""SELECT count(*) AS rows, 6 AS columns, {' + '.join(BYTES.values())} AS bytes,
      3 AS numeric_columns, 2 AS categorical_columns, 1 AS datetime_columns FROM orders""",
    "profile_columns": "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS null_count,
      round(100.0 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE), 2) AS null_pct,
      count(DISTINCT {c}) AS unique_count, {b} AS bytes FROM {LABELLED}""" for c, t, b in [
          ("doc_id", "bigint", "8 * count(doc_id)"), ("text", "string", "CAST(sum(strlen(text)) AS BIGINT)"), ("lang", "string", "CAST(sum(strlen(lang)) AS BIGINT)"),
          ("source", "string", "CAST(sum(strlen(source)) AS BIGINT)"), ("n_chars", "bigint", "8 * count(n_chars)"),
          ("quality", "int", "4 * count(quality)"), ("toxic", "int", "4 * count(toxic)")]),
    "profile_numeric": "\nUNION ALL\n".join(numbers_select(c) + WITH_NULLS for c in ("event_id", "user_id", "value")),
    "profile_categorical": union(TEXTS, TOP5),
    "profile_warnings": f"""WITH f AS ({union(WARNED, f'''SELECT '{{c}}' AS "column", count(*) AS n,
        100.0 * (count(*) - count({{c}})) / CAST(count(*) AS DOUBLE) AS null_pct,
        count(DISTINCT {{c}}) AS u FROM {LABELLED}''')})
      SELECT 'almost_empty' AS warning, "column", 'high' AS severity, null_pct AS measure FROM f WHERE null_pct > 90
      UNION ALL SELECT 'constant', "column", 'medium', CAST(u AS DOUBLE) FROM f WHERE u = 1
      UNION ALL SELECT 'high_cardinality', "column", 'medium', CAST(u AS DOUBLE) FROM f
        WHERE u > 1000 AND "column" IN ('lang', 'source')
      UNION ALL SELECT 'potential_id', "column", 'low', CAST(u AS DOUBLE) FROM f
        WHERE u = n AND contains(lower("column"), 'id')""",
    "profile": PROFILE_COLUMNS,
    "logical_types": per_order_column(lambda c: logical(c) + " AS logical_type"),
    "logical_types_texts": """SELECT 'text' AS "column", CASE WHEN avg(length(text)) > 100 THEN 'long_text' ELSE 'short_text' END
        AS logical_type FROM documents UNION ALL SELECT 'lang', 'short_text' UNION ALL SELECT 'address', 'likely_email'
      UNION ALL SELECT 'day', 'likely_date'""",
    "suggest_types": per_order_column(lambda c: suggested(c) + " AS suggested_type"),
    "dtypes_report": per_order_column(lambda c: f"""'{TYPES[c]}' AS type, {logical(c)} AS logical_type,
      count(*) > count({c}) AS nullable, count({c}) AS non_null, count(*) - count({c}) AS "null",
      count(DISTINCT {c}) AS "unique", round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 4) AS unique_ratio,
      {BYTES[c]} AS bytes, {suggested(c)} AS suggested_type"""),
    "column_classes": per_order_column(lambda c: f"""'{ {'bigint': 'numeric', 'double': 'numeric', 'string': 'categorical',
      'timestamp_ntz': 'datetime'}[TYPES[c]]}' AS "class", count({c}) AS non_null"""),
    "column_bytes": per_order_column(lambda c: f"{BYTES[c]} AS bytes") +
        f"\nUNION ALL SELECT '*', {' + '.join(BYTES.values())} FROM orders",
    "column_info": per_order_column(lambda c: f"""'{TYPES[c]}' AS type, count({c}) AS non_null, count(*) - count({c}) AS "null",
      count(DISTINCT {c}) AS "unique", {BYTES[c]} AS bytes, round({when_number(c, 'CAST(min({c}) AS DOUBLE)')}, 5) AS min,
      round({when_number(c, 'CAST(max({c}) AS DOUBLE)')}, 5) AS max, round({when_number(c, 'avg({c})')}, 5) AS mean,
      round({when_number(c, 'stddev_samp({c})')}, 5) AS std, {when_date(c, 'min({c})')} AS dt_min,
      {when_date(c, 'max({c})')} AS dt_max"""),
    "detect_categorical": union(TEXTS, """SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique",
      round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 6) AS ratio,
      count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.5 AND count(DISTINCT {c}) < 1000 AS is_category FROM orders"""),
    "suggest_downcast": union(["l_orderkey", "l_partkey", "l_suppkey"], """SELECT '{c}' AS "column", 'bigint' AS type,
      CASE WHEN max({c}) < 128 AND min({c}) >= -128 THEN 'tinyint' WHEN max({c}) < 32768 AND min({c}) >= -32768 THEN 'smallint'
        WHEN max({c}) < 2147483648 AND min({c}) >= -2147483648 THEN 'int' ELSE 'bigint' END AS suggested FROM lineitem""") +
      """ UNION ALL SELECT 'l_linenumber', 'int', CASE WHEN max(l_linenumber) < 128 AND min(l_linenumber) >= -128 THEN 'tinyint'
        WHEN max(l_linenumber) < 32768 AND min(l_linenumber) >= -32768 THEN 'smallint' ELSE 'int' END FROM lineitem
      UNION ALL """ + union(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], """SELECT '{c}', 'double',
        CASE WHEN max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))) <= 5e-4 THEN 'float' ELSE 'double' END FROM lineitem"""),
}

SQL |= {f"profile_whole_{part}": SQL[f"profile_{part}"] for part in ("overview", "numeric", "categorical", "warnings")}
