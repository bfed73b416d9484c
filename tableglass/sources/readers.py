"""Readers: CSV, JSON, Parquet and text, with the format found out."""

from __future__ import annotations

import os
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableglass.functions.columns import raw
from tableglass.sources.detect import SEPARATORS, csv_facts, file_name
from tableglass.sources.elements import json_pieces, judged, read_elements
from tableglass.sources.heads import head_lines, heads
from tableglass.sources.records import MARKS, WIDE, parsed_records

# The extensions of each format.
CSV_EXTENSIONS = (".csv", ".tsv", ".txt")
JSON_EXTENSIONS = (".json", ".jsonl")
PARQUET_EXTENSIONS = (".parquet", ".pq")
CORRUPT = "_corrupt_record"
TEXT_BYTES = 1 << 29  # a longer document is not taken as one text to infer types


def csv_groups(spark: SparkSession, path: str, sep: str | None, encoding: str | None) -> list[tuple[dict[str, str], str | list[str]]]:
    """(reader options, files) of the files that share separator and encoding; one row per file reaches the driver."""
    def options(s: str, e: str) -> dict[str, str]:
        # of encodings of two or four bytes lines are found if the order of bytes is known, else a file is read whole
        whole = e.upper() in ("UTF-16", "UTF-32")
        return {"sep": s, "encoding": e, "header": "true", "escape": '"', "multiLine": str(whole).lower()}
    if sep and encoding:
        return [(options(sep, encoding), path)]
    groups = defaultdict(list)
    for row in csv_facts(spark, path).collect():
        groups[sep or row["separator"], encoding or row["encoding"]].append(file_name(row["file"]))
    for s, e in [k for k in groups if k[1] in ("UTF-16", "UTF-32")]:
        for exact, files in byte_orders(spark, groups.pop((s, e)), e).items():
            groups[s, exact] += files
    return [(options(*key), sorted(files)) for key, files in sorted(groups.items())] or [(options(sep or SEPARATORS[0], encoding or "UTF-8"), path)]


def byte_orders(spark: SparkSession, files: list[str], encoding: str) -> dict[str, list[str]]:
    """The files by their exact encoding, from the byte order mark; the one named where it can't be read by itself."""
    mark = F.hex(F.substring("head", 1, 4))
    little, big = ("FFFE", "FEFF") if encoding == "UTF-16" else ("FFFE0000", "0000FEFF")
    exact = F.when(mark.startswith(little), f"{encoding}LE").when(mark.startswith(big), f"{encoding}BE").otherwise(encoding)
    found = defaultdict(list)
    for row in heads(spark, files, 4).select("file", F.coalesce(exact, F.lit(encoding)).alias("encoding")).collect():
        found[row["encoding"]].append(file_name(row["file"]))
    return found


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables under their columns' names; a column that some lack is NULL there. Where types differ, numbers
    become DOUBLE and all else text."""
    kinds = defaultdict(set)
    for f in (f for t in tables for f in t.schema.fields):
        kinds[f.name].add(f.dataType)

    def common(name: str) -> T.DataType | None:
        if len(kinds[name]) == 1:
            return None
        return T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds[name]) else T.StringType()
    alike = [t.select(*[raw(c).cast(common(c)).alias(c) if common(c) else raw(c) for c in t.columns]) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


def read_csv_auto(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
    schema: T.StructType | None = None, skip_bad: bool = True, multi_line: bool = False,
) -> DataFrame:
    """CSV with a header; separator, encoding and types are found out unless given, the first two for each file.

    Lines with more fields than the header are skipped. ``skip_bad=False`` keeps their first fields
    instead and lets Spark parse only the columns asked for. ``multi_line=True`` accepts line breaks inside quotes; many tasks
    read a file all the same, in UTF-16 and UTF-32 too.
    """
    if skip_bad:
        return read_csv_report_bad(spark, path, sep, encoding, schema, multi_line)[0]
    tables = []
    for options, files in csv_groups(spark, path, sep, encoding):
        if by_records(options, multi_line):
            fields, _ = parsed_records(spark, files, options, schema, CORRUPT)
            tables.append(fields.drop(CORRUPT))
            continue
        if multi_line:
            options["multiLine"] = "true"
        reader = spark.read.options(**options)
        tables.append(reader.schema(schema).csv(files) if schema else reader.csv(files, inferSchema=True))
    return together(tables)


def read_csv_report_bad(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
    schema: T.StructType | None = None, multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a line with more fields than the header is bad and left out of the
    rows; one with fewer is filled with NULL. Bad lines come as (line)."""
    parts = [_csv_part(spark, files, options, schema, by_records(options, multi_line)) for options, files in csv_groups(spark, path, sep, encoding)]
    return together([good for good, _ in parts]), together([bad for _, bad in parts])


def by_records(options: dict[str, str], multi_line: bool) -> bool:
    """Whether records are found over lines; where the order of two or four bytes isn't known, Spark reads a file whole."""
    return options["encoding"].upper() in WIDE or multi_line and options["multiLine"] == "false"


def _csv_part(
    spark: SparkSession, files: str | list[str], options: dict[str, str], schema: T.StructType | None, records: bool,
) -> tuple[DataFrame, DataFrame]:
    if records:
        lines, schema = parsed_records(spark, files, options, schema, CORRUPT)
    else:
        reader = spark.read.options(**options)
        if schema is None:
            schema = reader.csv(files, inferSchema=True).schema
        marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        # without pruning: a line is judged by all its fields, whichever are asked for
        lines = spark.read.options(**options, columnPruning="false").schema(marked).csv(
            files, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    unquoted = F.regexp_replace(F.col(CORRUPT), '"[^"]*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(options["sep"]), F.lit(""))) + 1
    too_many = F.coalesce(fields > len(schema.fields), F.lit(False))
    names = [raw(f.name) for f in schema.fields]
    # Spark refuses to read the corrupt lines alone, so the test names a parsed field as well
    read = names[0].isNull() | names[0].isNotNull()
    return (lines.filter(read & ~too_many).select(*names),
            lines.filter(read & too_many).select(F.col(CORRUPT).alias("line")))


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested objects as columns with dotted names; lists stay whole."""
    def leaves(column, name: str, data_type: T.DataType):
        if isinstance(data_type, T.StructType):
            for f in data_type.fields:
                yield from leaves(column.getField(f.name), f"{name}.{f.name}", f.dataType)
        else:
            yield column.alias(name)
    return df.select(*[c for f in df.schema.fields for c in leaves(raw(f.name), f.name, f.dataType)])


def json_layouts(spark: SparkSession, path: str) -> dict[str, str | list[str]]:
    """The files by layout, from their first line that is not blank: ``list`` where it begins with [, ``object`` where it begins
    with a { that does not close on the line, else ``lines``. A single file with a single line is an ``object`` too. Files that
    are all alike are named by the path itself, however many they are; else a row for each reaches the driver.

    The first bytes of a file tell as a rule; only a file whose first line is longer, or that may have no second one, is read.
    """
    return json_facts(spark, path)[0]


def json_facts(spark: SparkSession, path: str) -> tuple[dict[str, str | list[str]], int]:
    """(:func:`json_layouts`, bytes of the longest file), from one pass over the heads."""
    complete = F.filter(F.transform(head_lines(F.col("head"), F.col("length")), lambda x: F.trim(x)), lambda x: x != "")
    begin = F.trim(F.regexp_replace(F.col("head").cast("string"), "^[ \r\n]+", ""))
    known = heads(spark, path).select("file", "length", F.coalesce(F.substring(begin, 1, 1), F.lit("")).alias("mark"), F.get(complete, F.lit(0)).alias("first"),
                                      F.coalesce(F.size(complete), F.lit(0)).alias("lines"), (F.col("length") <= F.octet_length("head")).alias("all"))
    whole = F.from_json("first", "map<string,string>").isNotNull()

    def layout(alone: bool) -> Column:
        single = (F.col("lines") == 1) & F.lit(alone)
        cut = F.col("first").isNull() | single & ~F.coalesce("all", F.lit(False))
        unread = F.when((F.col("mark") != "") | ~F.coalesce("all", F.lit(False)), "unknown").otherwise("blank")  # a file of blanks has no rows
        return F.when(F.col("mark") == "[", "list").when((F.col("mark") == "") | cut, unread).when(
            (F.col("mark") == "{") & (single | ~whole), "object").otherwise("lines")
    facts = known.select("file", "length", layout(False).alias("layout"), layout(True).alias("alone"))
    counted = facts.groupBy("layout", "alone").agg(F.count(F.lit(1)).alias("files"), F.max("length").alias("longest")).collect()
    longest = max((r["longest"] for r in counted), default=0)
    alone = sum(r["files"] for r in counted) == 1
    kind = "alone" if alone else "layout"
    kinds = {r[kind] for r in counted} - {"blank"}
    if len(kinds) == 1 and "unknown" not in kinds:
        return {kinds.pop(): path}, longest
    found = defaultdict(list)
    for row in facts.filter(F.col(kind) != "blank").select("file", kind).collect() if kinds else ():
        found[row[kind]].append(file_name(row["file"]))
    unknown = found.pop("unknown", [])
    for name, files in (scanned_layouts(spark, unknown, alone) if unknown else {}).items():
        found[name] += files
    return {k: sorted(v) for k, v in found.items()}, longest


def scanned_layouts(spark: SparkSession, path: list[str], alone: bool) -> dict[str, list[str]]:
    """The layouts of files whose first lines are long or packed, found by reading them."""
    text = F.trim("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), text.alias("text"),
                                         F.monotonically_increasing_id().alias("line")).filter(F.col("text") != "")
    first = F.min_by(F.struct(F.substring("text", 1, 1).alias("mark"), F.from_json("text", "map<string,string>").isNotNull().alias("whole")), "line")
    found = defaultdict(list)
    for row in lines.groupBy("file").agg(first.alias("first"), F.count(F.lit(1)).alias("lines")).collect():
        mark, whole = row["first"]["mark"], row["first"]["whole"]
        found["list" if mark == "[" else "object" if mark == "{" and (alone and row["lines"] == 1 or not whole) else "lines"].append(file_name(row["file"]))
    return found


def file_names(spark: SparkSession, path: str | list[str], longer_than: int) -> list[str]:
    """The files of more bytes; a row for each reaches the driver."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > longer_than).select("path")
    return [file_name(r["path"]) for r in files.collect()]


def large_lists(
    spark: SparkSession, layout: str, files: str | list[str], cut_bytes: int | None, longest: int,
) -> tuple[list[str], DataFrame | None]:
    """(those of the files above ``cut_bytes`` that are a list of objects throughout, their elements)."""
    depth = {"list": 1, "object": 2}.get(layout)
    if depth is None:
        return [], None
    if cut_bytes is None:  # a smaller file is one task's work in any case
        cut_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    large = file_names(spark, files, cut_bytes) if longest > cut_bytes else []
    pieces = json_pieces(spark, large, depth) if large else None
    cut = [file_name(f) for f in judged(pieces)] if large else []
    return cut, json_pieces(spark, cut, depth) if cut and len(cut) < len(large) else pieces


def document_texts(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """(value): each file as one text. UTF-16LE and UTF-32LE show by the bytes of zero behind the first one; what isn't in any of
    these encodings is no JSON, and neither is the text that stands for it."""
    content = spark.read.text(files, wholetext=True).select("value", F.col("value").cast("binary").alias("bytes"))
    first = F.hex(F.substring("bytes", 1, 4))
    text = F.when(first.rlike("^..000000"), F.decode(F.concat(F.lit(MARKS["UTF-32LE"]), F.col("bytes")), "UTF-32")).when(
        first.rlike("^..00"), F.decode("bytes", "UTF-16LE")).when(F.is_valid_utf8("value"), F.col("value")).otherwise("{")
    return content.select(text.alias("value")).filter(F.col("value").rlike(r"\S"))


def read_documents(spark: SparkSession, files: str | list[str], whole: bool) -> DataFrame:
    """The rows of files with one JSON document each. To infer the types of many files Spark goes through the list of all of them in
    each task and for each file, so they are inferred from the documents as texts; not ``whole`` says that one is too long for that."""
    reader = spark.read.option("columnNameOfCorruptRecord", CORRUPT)
    if whole:
        texts = getattr(document_texts(spark, files)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        reader = reader.schema(reader._df(reader._jreader.json(texts)).schema)
    return reader.json(files, multiLine=True)


def read_json_auto(spark: SparkSession, path: str, cut_bytes: int | None = None) -> DataFrame:
    """JSON in any of four layouts, found out for each file: one object per line; a list of objects; one object holding a
    single list (its elements become the rows); one other object (flattened to one row).

    Lines are read in parallel, and so are the elements of a list of objects in a document of more than ``cut_bytes`` (what
    Spark gives to one task of a file); other documents by one task each. What is no JSON is an error, never left out;
    :func:`read_json_report_bad` returns bad lines beside the good ones.
    """
    tables = []
    layouts, longest = json_facts(spark, path)
    for layout, files in sorted(layouts.items()):
        cut, pieces = large_lists(spark, layout, files, cut_bytes, longest)
        if cut:
            df = read_elements(pieces, CORRUPT)
            if CORRUPT in df.columns:
                raise ValueError(f"{path}: elements of a list that are no JSON")
            tables.append(df)
            files = sorted(set(file_names(spark, files, 0) if isinstance(files, str) else files) - set(cut))
        if not files:
            continue
        if layout == "lines":
            df = spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(files)
        else:
            df = read_documents(spark, files, longest <= TEXT_BYTES or not file_names(spark, files, TEXT_BYTES))
        if CORRUPT in df.columns:
            raise ValueError(f"{path}: not JSON in any known layout, or lines that are malformed (read_json_report_bad shows them)")
        tables.append(_of_object(df) if layout == "object" else df)
    return together(tables) if tables else spark.createDataFrame([], T.StructType())


def _of_object(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    if len(fields) == 1 and isinstance(fields[0].dataType, T.ArrayType):
        name = fields[0].name
        if isinstance(fields[0].dataType.elementType, T.StructType):
            return df.select(F.inline(raw(name)))
        return df.select(F.explode(raw(name)).alias("0"))
    return flatten_struct(df)


def read_json_report_bad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of files with one object per line. Bad lines come as (line)."""
    found = spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    fields = [f for f in found.schema.fields if f.name != CORRUPT]
    marked = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.schema(marked).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    names = [raw(f.name) for f in fields]
    # as for CSV, the test names a parsed field as well
    read = names[0].isNull() | names[0].isNotNull() if names else F.lit(True)
    bad = F.col(CORRUPT).isNotNull()
    return lines.filter(read & ~bad).select(*names), lines.filter(read & bad).select(F.col(CORRUPT).alias("line"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(content): one row per line."""
    return spark.read.text(path).withColumnRenamed("value", "content")


def extension_of(spark: SparkSession, path: str) -> str:
    """The extension of the path, or that of the files below it when the path is a folder."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension:
        return extension
    files = spark.read.format("binaryFile").load(path).select("path")
    name = files.agg(F.min("path").alias("path")).first()["path"]
    return os.path.splitext(name or "")[1].lower()


def read_any(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(table, metadata): the reader is chosen by extension; unknown ones are tried as CSV, JSON
    and lines of text.

    The metadata is one row: filename, extension, size_bytes, detected_format, rows, columns.
    """
    extension = extension_of(spark, path)
    if extension in CSV_EXTENSIONS:
        df, detected = read_csv_auto(spark, path), "CSV/TSV"
    elif extension in JSON_EXTENSIONS:
        df, detected = read_json_auto(spark, path), "JSON"
    elif extension in PARQUET_EXTENSIONS:
        df, detected = read_parquet(spark, path), "Parquet"
    else:
        df, detected = read_unknown(spark, path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("size")).scalar()
    metadata = df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(os.path.basename(path.rstrip("/"))).alias("filename"), F.lit(extension).alias("extension"),
        size.alias("size_bytes"), F.lit(detected).alias("detected_format"), "rows",
        F.lit(len(df.columns)).alias("columns"))
    return df, metadata


def read_unknown(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Spark reads any text as CSV, so JSON is recognised first, then a line with a separator."""
    try:
        return read_json_auto(spark, path), "JSON (auto-detect)"
    except ValueError:
        df = read_csv_auto(spark, path)
        if len(df.columns) > 1:
            return df, "CSV (auto-detect)"
        return read_text_lines(spark, path), "Text (fallback)"
