"""Correlations."""

from pyspark.sql import functions as F

from registry import rounded, table
from registry.profile import LABELLED, labelled
from registry.stats import WITH_NULLS, with_nulls
from tableglass.operators import correlate

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem(s, d):
    return table(s, d, "lineitem").select(*PRICES)


def pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def pearson_sql(columns, of, method="{a}, {b}"):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS r FROM {of}"
        for a, b in pairs(columns))


def spearman_sql(columns, of):
    """Pearson of the average ranks among the rows complete for the pair."""
    rank = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, corr(x, y) AS r FROM (SELECT CAST({rank.replace('{c}', a)} AS DOUBLE) AS x,
        CAST({rank.replace('{c}', b)} AS DOUBLE) AS y FROM {of} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in pairs(columns))


def kendall_sql(columns, of):
    """tau-b from all pairs of distinct value combinations."""
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, (SELECT sum(p.c * q.c * sign(p.x - q.x) * sign(p.y - q.y)) / 2.0 FROM
          (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS c FROM {of} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) p,
          (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS c FROM {of} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) q)
          / sqrt((SELECT n0 - sum(c * (c - 1) / 2) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM {of} WHERE {b} IS NOT NULL AND {a} IS NOT NULL GROUP BY {a}))
               * (SELECT n0 - sum(c * (c - 1) / 2) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM {of} WHERE {b} IS NOT NULL AND {a} IS NOT NULL GROUP BY {b}))) AS r
        FROM (SELECT count(*) * (count(*) - 1.0) / 2 AS n0 FROM {of} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in pairs(columns))


def related(s, d):
    """A price, what follows from it, its opposite and a constant."""
    return table(s, d, "lineitem").select(
        "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (-F.col("l_quantity")).alias("minus"), "l_quantity", F.lit(1.0).alias("constant"))


RELATED = """(SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS minus, l_quantity,
  CAST(1 AS DOUBLE) AS "constant" FROM lineitem)"""
NAMES = ["l_extendedprice", "net", "minus", "l_quantity", "\"constant\""]


def numbers_of(s, d):
    return labelled(s, d).select("n_chars", "quality", "toxic")


def unquoted(sql):
    return sql.replace("'\"constant\"'", "'constant'")


WIDE = [f"c{i}" for i in range(24)]
# columns of every kind: related, unrelated, with many or few values, one constant; every third lacks values
CELL = "CASE WHEN {i} % 3 = 2 AND l_suppkey % ({i} + 3) = 0 THEN NULL ELSE l_quantity * {i} + l_partkey % ({i} * 7 + 1) - l_linenumber * 1000.0 * ({i} % 2) END"
FULL = [c for i, c in enumerate(WIDE) if i and i % 3 != 2] + [f"d{i}" for i in range(3)]
MORE = "l_extendedprice * {i} + l_quantity * 50.0"


def wide(s, d):
    return table(s, d, "lineitem").selectExpr(*[f"CAST({CELL.format(i=i)} AS DOUBLE) AS c{i}" for i in range(24)])


def wide_full(s, d):
    return table(s, d, "lineitem").selectExpr(
        *[f"CAST({CELL.format(i=i)} AS DOUBLE) AS c{i}" for i in range(1, 24) if i % 3 != 2], *[f"CAST({MORE.format(i=i)} AS DOUBLE) AS d{i}" for i in range(3)])


def wide_sql(names):
    cells = [f"CAST({CELL.format(i=int(c[1:])) if c[0] == 'c' else MORE.format(i=int(c[1:]))} AS DOUBLE) AS {c}" for c in names]
    return f"(SELECT {', '.join(cells)} FROM lineitem)"


QUERIES = {
    "corr_pearson": lambda s, d: rounded(correlate.corr_pearson(table(s, d, "lineitem"))),
    "corr_pearson_nulls": lambda s, d: rounded(correlate.corr_pearson(with_nulls(s, d))),
    "corr_pearson_constant": lambda s, d: rounded(correlate.corr_pearson(related(s, d))),
    "corr_spearman": lambda s, d: rounded(correlate.corr_spearman(lineitem(s, d))),
    "corr_spearman_nulls": lambda s, d: rounded(correlate.corr_spearman(with_nulls(s, d), ["user_id", "value"])),
    "corr_pearson_wide": lambda s, d: rounded(correlate.corr_pearson(wide(s, d))),
    "corr_spearman_wide": lambda s, d: rounded(correlate.corr_spearman(wide_full(s, d))),
    "corr_kendall": lambda s, d: rounded(correlate.corr_kendall(lineitem(s, d), ["l_quantity", "l_discount", "l_tax"])),
    "corr_kendall_nulls": lambda s, d: rounded(correlate.corr_kendall(numbers_of(s, d))),
    "corr_kendall_unique_values": lambda s, d: rounded(correlate.corr_kendall(
        lineitem(s, d), ["l_quantity", "l_extendedprice"])),
    "strong_correlations": lambda s, d: correlate.strong_correlations(related(s, d)),
    "corr_heatmap": lambda s, d: rounded(correlate.corr_heatmap(lineitem(s, d))),
    "corr_heatmap_masked": lambda s, d: rounded(correlate.corr_heatmap(lineitem(s, d), mask_upper=True)),
    "corr_heatmap_spearman": lambda s, d: rounded(correlate.corr_heatmap(
        lineitem(s, d), "spearman", mask_upper=True, columns=["l_quantity", "l_discount", "l_tax"])),
}


def six(sql):
    return f"SELECT var1, var2, round(r, 6) AS r FROM ({sql})"


SQL = {
    "corr_pearson": six(pearson_sql(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PRICES], "lineitem")),
    "corr_pearson_nulls": six(pearson_sql(["event_id", "user_id", "value"], WITH_NULLS)),
    "corr_pearson_constant": six(unquoted(pearson_sql(NAMES, RELATED))),
    "corr_pearson_wide": f"WITH w AS MATERIALIZED {wide_sql(WIDE)} " + six(pearson_sql(WIDE, "w")),
    "corr_spearman_wide": f"WITH w AS MATERIALIZED {wide_sql(FULL)} " + six(spearman_sql(FULL, "w")),
    "corr_spearman": six(spearman_sql(PRICES, "lineitem")),
    "corr_spearman_nulls": six(spearman_sql(["user_id", "value"], WITH_NULLS)),
    "corr_kendall": six(kendall_sql(["l_quantity", "l_discount", "l_tax"], "lineitem")),
    "corr_kendall_nulls": six(kendall_sql(["n_chars", "quality", "toxic"], LABELLED)),
    "strong_correlations": f"""SELECT var1, var2, round(r, 3) AS correlation,
      CASE WHEN abs(r) > 0.9 THEN 'very strong' ELSE 'strong' END AS strength,
      CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
      FROM ({unquoted(pearson_sql(NAMES, RELATED))}) WHERE abs(r) > 0.7 ORDER BY abs(r) DESC LIMIT 10""",
    "corr_heatmap": f"""WITH p AS ({pearson_sql(PRICES, 'lineitem')}) SELECT "row", "col", round(r, 6) AS r, round(r, 2) AS label FROM (
      SELECT var1 AS "row", var2 AS "col", r FROM p UNION ALL SELECT var2, var1, r FROM p UNION ALL
      SELECT unnest({PRICES}) AS c, c, 1.0)""",
    "corr_heatmap_masked": f"""SELECT var2 AS "row", var1 AS "col", round(r, 6) AS r, round(r, 2) AS label
      FROM ({pearson_sql(PRICES, 'lineitem')})""",
    "corr_heatmap_spearman": f"""SELECT var2 AS "row", var1 AS "col", round(r, 6) AS r, round(r, 2) AS label
      FROM ({spearman_sql(['l_quantity', 'l_discount', 'l_tax'], 'lineitem')})""",
}
