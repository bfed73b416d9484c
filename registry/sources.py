"""Readers, writers and type inference, over files that Spark first writes from the tables."""

from pyspark.sql import functions as F

from registry import rounded, table
from tableglass.plans.scratch import scratch_folder
from tableglass.sources import detect, infer, readers, writers


def orders(s, d):
    return table(s, d, "orders")


def french(s, d):
    """customer with accents in the segment, within Latin-1."""
    return table(s, d, "customer").select("c_custkey", F.concat(F.lit("marché été "), F.lower("c_mktsegment")).alias("segment"))


def written(s, df, kind, **options):
    """The folder the table was written to."""
    path = scratch_folder(s)
    getattr(df.write.options(**options), kind)(path)
    return path


def csv(s, d, **options):
    return written(s, orders(s, d).withColumn("o_orderdate", F.col("o_orderdate").cast("date")), "csv", header=True, **options)


def bad_lines(s, d):
    """Orders as lines of CSV: every tenth has a field too many, every eleventh one too few."""
    df = orders(s, d)
    fields = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    line = F.when(F.col("o_orderkey") % 10 == 0, F.concat_ws(";", *fields, F.lit("extra"))).when(
        F.col("o_orderkey") % 11 == 0, F.concat_ws(";", *fields[:2])).otherwise(F.concat_ws(";", *fields))
    lines = df.select(line.alias("value"))
    # a column named like the header, and a separator and quotes that occur in no line
    return written(s, lines.withColumnRenamed("value", "key;customer;status"), "csv", header=True, sep="\x01", quote="\x02", escape="\x03")


def json_lines(s, d):
    return written(s, orders(s, d), "json")


def bad_json_lines(s, d):
    """Orders as lines of JSON, every tenth cut off."""
    df = orders(s, d)
    line = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    return written(s, df.select(F.when(F.col("o_orderkey") % 10 == 0, F.substr(line, F.lit(1), F.lit(20))).otherwise(line).alias("value")), "text")


def as_document(s, records, before, after, each=1000):
    """JSON documents of up to about ``each`` records, spread over lines, a file for each."""
    n = records.count()
    parts = records.withColumn("part", F.floor(F.xxhash64("record").cast("double") / 2.0**64 * F.ceil(F.lit(n / each))))
    # files of a task are written one by one, so a task gets about 64; more where that would take more tasks than a shuffle has
    tasks = min(n // (64 * each) + 1, int(s.conf.get("spark.sql.shuffle.partitions")))
    text = parts.repartition(tasks, "part").groupBy("part").agg(F.concat(
        F.lit(before), F.array_join(F.sort_array(F.collect_list("record")), ",\n"), F.lit(after)).alias("value")).select("value")
    return written(s, text, "text", maxRecordsPerFile=1)


def broken_lines(s, d):
    """Orders as CSV with a remark that holds line breaks, quotes and separators, in one file a task."""
    o = orders(s, d)
    remark = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('first "line"\n'), F.col("o_orderpriority"), F.lit(",\n\nlast"))).otherwise(F.col("o_orderpriority"))
    return written(s, o.select("o_orderkey", remark.alias("remark"), "o_totalprice"), "csv", header=True, escape='"')


def mixed(s, first, second):
    """A folder of folders: the first half of a table written one way, the second half another way."""
    path = scratch_folder(s)
    for name, (df, options) in {"a": first, "b": second}.items():
        df.write.options(header=True, **options).csv(f"{path}/{name}")
    return f"{path}/*"


def mixed_separators(s, d):
    df = orders(s, d).drop("o_orderdate")
    return mixed(s, (df.filter("o_orderkey % 2 = 0"), {"sep": ";"}), (df.filter("o_orderkey % 2 = 1"), {"sep": ","}))


def mixed_encodings(s, d):
    df = french(s, d)
    return mixed(s, (df.filter("c_custkey % 2 = 0"), {"sep": "|", "encoding": "ISO-8859-1"}), (df.filter("c_custkey % 2 = 1"), {"sep": "|"}))


def one_element(s, d):
    """A list with one nested object, a document for each supplier."""
    nested = table(s, d, "supplier").select(F.to_json(F.struct("s_suppkey", F.struct("s_name", F.struct("s_acctbal").alias("account")).alias("who"))).alias("value"))
    documents = nested.select(F.concat(F.lit("[\n"), "value", F.lit("\n]")).alias("value"))
    return written(s, documents.repartition(documents.count() // 500 + 1), "text", maxRecordsPerFile=1)  # files of a task are written one by one


def json_records(s, d):
    return orders(s, d).select(F.to_json(F.struct("o_orderkey", "o_orderpriority")).alias("record"))


def one_list(s, d):
    """One document with all orders in one list, its elements with nested objects, quotes, brackets and backslashes; written by one task."""
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.lit('a "}" and ]\\')).otherwise(F.col("o_orderpriority"))
    record = F.to_json(F.struct("o_orderkey", odd.alias("remark"), F.struct("o_totalprice", F.array(F.struct("o_custkey")).alias("list")).alias("more")))
    least = orders(s, d).agg(F.min("o_orderkey")).scalar()
    lines = orders(s, d).select("o_orderkey", F.concat(F.when(F.col("o_orderkey") == least, "[").otherwise(","), record).alias("value"))
    end = orders(s, d).agg((F.max("o_orderkey") + 1).alias("o_orderkey"), F.lit("]").alias("value"))
    return written(s, lines.unionByName(end).coalesce(1).sortWithinPartitions("o_orderkey").select("value"), "text")


def nested(s, d):
    o = orders(s, d)
    return o.select("o_orderkey", F.struct("o_totalprice", F.struct("o_orderstatus", "o_orderpriority").alias("state")).alias("order"))


def one_object(s, d):
    """Totals of orders as one nested JSON object."""
    totals = orders(s, d).agg(F.to_json(F.struct(
        F.count(F.lit(1)).alias("orders"), F.struct(F.min("o_custkey").alias("least"), F.max("o_custkey").alias("most")).alias("customer"))).alias("value"))
    return written(s, totals, "text")


def texts_of(s, d):
    """Orders with every column as text: dates day first, prices with a decimal comma and spaces."""
    return orders(s, d).select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.replace(F.concat_ws(" ", F.col("o_totalprice").cast("string"), F.lit("")), F.lit("."), F.lit(",")).alias("price"),
        "o_orderpriority")


TEXTS = """(SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders)"""


def csv_read_back(s, d):
    """A CSV with semicolons, read without being told."""
    return readers.read_csv_auto(s, csv(s, d, sep=";")).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


QUERIES = {
    "read_csv_auto": csv_read_back,
    "read_csv_latin1": lambda s, d: readers.read_csv_auto(
        s, written(s, french(s, d), "csv", header=True, sep="|", encoding="ISO-8859-1")),
    "detect_separator": lambda s, d: detect.detect_separator(s, csv(s, d, sep="\t")).groupBy("separator").agg(
        (F.count(F.lit(1)) > 0).alias("found")),
    "detect_encoding": lambda s, d: detect.detect_encoding(
        s, written(s, french(s, d), "csv", encoding="ISO-8859-1")).select("encoding").distinct().unionAll(
        detect.detect_encoding(s, written(s, french(s, d), "csv")).select("encoding").distinct()),
    "read_csv_report_bad": lambda s, d: readers.read_csv_report_bad(s, bad_lines(s, d))[0],
    "read_csv_bad_lines": lambda s, d: readers.read_csv_report_bad(s, bad_lines(s, d))[1],
    "read_csv_line_breaks": lambda s, d: readers.read_csv_auto(s, broken_lines(s, d), sep=",", multi_line=True),
    "read_csv_mixed_separators": lambda s, d: readers.read_csv_auto(s, mixed_separators(s, d)),
    "read_csv_mixed_encodings": lambda s, d: readers.read_csv_auto(s, mixed_encodings(s, d)),
    "read_json_lines": lambda s, d: readers.read_json_auto(s, json_lines(s, d)).withColumn("o_orderdate", F.to_timestamp_ntz("o_orderdate")),
    "read_json_good_lines": lambda s, d: readers.read_json_report_bad(s, bad_json_lines(s, d))[0],
    "read_json_bad_lines": lambda s, d: readers.read_json_report_bad(s, bad_json_lines(s, d))[1],
    "read_json_one_element": lambda s, d: readers.read_json_auto(s, one_element(s, d)).select("s_suppkey", "who.s_name", "who.account.s_acctbal"),
    "read_json_one_list": lambda s, d: readers.read_json_auto(s, one_list(s, d), cut_bytes=0).select(
        "o_orderkey", "remark", "more.o_totalprice", F.col("more.list")[0]["o_custkey"].alias("o_custkey")),
    "read_json_array": lambda s, d: readers.read_json_auto(s, as_document(s, json_records(s, d), "[\n", "\n]")),
    "read_json_root": lambda s, d: readers.read_json_auto(s, as_document(s, json_records(s, d), '{"data": [\n', "\n]}")),
    "read_json_object": lambda s, d: readers.read_json_auto(s, one_object(s, d)),
    "flatten_struct": lambda s, d: readers.flatten_struct(nested(s, d)),
    "read_parquet": lambda s, d: readers.read_parquet(s, f"{d}/orders.parquet"),
    "read_text_lines": lambda s, d: readers.read_text_lines(s, written(s, table(s, d, "part").select("p_name"), "text")),
    "read_any_csv": lambda s, d: readers.read_any(s, csv(s, d, sep="|"))[0].withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
    "read_any_json": lambda s, d: readers.read_any(s, json_lines(s, d))[0].withColumn("o_orderdate", F.to_timestamp_ntz("o_orderdate")),
    "read_any_metadata": lambda s, d: readers.read_any(s, f"{d}/orders.parquet")[1].drop("size_bytes"),
    "write_csv": lambda s, d: exported(s, d, None),
    "write_csv_first": lambda s, d: exported(s, d, 1000),
    # types
    "infer_datetime": lambda s, d: infer.infer_datetime(texts_of(s, d), ["day", "iso", "o_orderpriority"]).select(
        "o_orderkey", F.col("day").cast("timestamp_ntz").alias("day"), F.col("iso").cast("timestamp_ntz").alias("iso"),
        "o_orderpriority"),
    "infer_numeric": lambda s, d: infer.infer_numeric(texts_of(s, d), ["price", "o_orderpriority"]).select(
        "o_orderkey", "price", "o_orderpriority"),
    "infer_types": lambda s, d: rounded(infer.infer_types(texts_of(s, d), aggressive=True)[0].select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("day").cast("timestamp_ntz").alias("day"),
        "price", "o_orderpriority")),
    "infer_types_conversions": lambda s, d: infer.infer_types(texts_of(s, d), aggressive=True)[1],
}


def exported(s, d, n):
    path = scratch_folder(s)
    writers.write_csv(orders(s, d).drop("o_orderdate"), path, n, "o_orderkey")
    return s.read.csv(path, header=True, inferSchema=True).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus", "o_totalprice", "o_orderpriority")


COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"

SQL = {
    # Spark infers the narrowest of INT and BIGINT for CSV, always BIGINT for JSON
    "read_csv_auto": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
      o_totalprice, o_orderdate, o_orderpriority FROM orders""",
    "read_csv_latin1": "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, concat('marché été ', lower(c_mktsegment)) AS segment FROM customer",
    "detect_separator": "SELECT chr(9) AS separator, true AS found",
    "detect_encoding": "SELECT 'ISO-8859-1' AS encoding UNION ALL SELECT 'UTF-8'",
    "read_csv_report_bad": """SELECT CAST(o_orderkey AS INTEGER) AS key, CAST(o_custkey AS INTEGER) AS customer,
      CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 0""",
    "read_csv_bad_lines": """SELECT concat_ws(';', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, 'extra') AS line
      FROM orders WHERE o_orderkey % 10 = 0""",
    "read_csv_line_breaks": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CASE WHEN o_orderkey % 3 = 0
      THEN concat('first "line"', chr(10), o_orderpriority, ',', chr(10), chr(10), 'last') ELSE o_orderpriority END AS remark, o_totalprice FROM orders""",
    "read_csv_mixed_separators": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
      o_totalprice, o_orderpriority FROM orders""",
    "read_csv_mixed_encodings": "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, concat('marché été ', lower(c_mktsegment)) AS segment FROM customer",
    "read_json_good_lines": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0",
    "read_json_bad_lines": """SELECT left(concat('{"o_orderkey":', o_orderkey, ',"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '"}'), 20) AS line
      FROM orders WHERE o_orderkey % 10 = 0""",
    "read_json_one_element": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "read_json_one_list": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a "}" and ]\\' ELSE o_orderpriority END AS remark,
      o_totalprice, o_custkey FROM orders""",
    "read_json_lines": f"SELECT {COLUMNS}, o_orderdate FROM orders",
    "read_json_array": "SELECT o_orderkey, o_orderpriority FROM orders",
    "read_json_root": "SELECT o_orderkey, o_orderpriority FROM orders",
    "read_json_object": """SELECT count(*) AS orders, min(o_custkey) AS "customer.least", max(o_custkey) AS "customer.most" FROM orders""",
    "flatten_struct": """SELECT o_orderkey, o_totalprice AS "order.o_totalprice", o_orderstatus AS "order.state.o_orderstatus",
      o_orderpriority AS "order.state.o_orderpriority" FROM orders""",
    "read_parquet": "SELECT * FROM orders",
    "read_text_lines": "SELECT p_name AS content FROM part",
    "read_any_csv": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
      o_totalprice, o_orderdate, o_orderpriority FROM orders""",
    "read_any_json": f"SELECT {COLUMNS}, o_orderdate FROM orders",
    "read_any_metadata": """SELECT 'orders.parquet' AS filename, '.parquet' AS extension, 'Parquet' AS detected_format,
      count(*) AS rows, 6 AS columns FROM orders""",
    "write_csv": f"SELECT {COLUMNS} FROM orders",
    "write_csv_first": f"SELECT {COLUMNS} FROM orders ORDER BY o_orderkey LIMIT 1000",
    "infer_datetime": "SELECT o_orderkey, o_orderdate AS day, o_orderdate AS iso, o_orderpriority FROM orders",
    "infer_numeric": "SELECT o_orderkey, o_totalprice AS price, o_orderpriority FROM orders",
    "infer_types": """SELECT o_orderkey, o_orderdate AS day, round(o_totalprice, 6) AS price, o_orderpriority FROM orders""",
    "infer_types_conversions": """SELECT 'day' AS "column", 'string → datetime' AS conversion UNION ALL SELECT 'iso', 'string → datetime'
      UNION ALL SELECT 'price', 'string → numeric' UNION ALL SELECT 'o_orderpriority', 'string → category'
      UNION ALL SELECT 'o_orderkey', CASE WHEN max(o_orderkey) < 128 THEN 'bigint → tinyint'
        WHEN max(o_orderkey) < 32768 THEN 'bigint → smallint' ELSE 'bigint → int' END FROM orders""",
}
