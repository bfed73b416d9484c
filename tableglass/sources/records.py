"""Records of CSV that may hold line breaks in quotes, found by all tasks at once.

Whether a line begins inside quotes follows from the number of quotes before it: an automaton of two states, whose steps over
a range of lines add up to one bit. Each block of a file is counted by itself, running sums over the blocks of a file tell
each one its state at the start, and the task that reads a block keeps it from line to line.
"""

from __future__ import annotations

import csv

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableglass.sources.blocks import BLOCK, before_block, blocks, cut_texts, stored


def times(c: Column, character: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(character), F.lit("")))


def stitched(placed: DataFrame, glue: Column) -> DataFrame:
    """(file, start, line, text): lines put together, over the borders of blocks too. ``placed`` has (file, start, line, value) and
    says of each line whether it ``begins`` something and whether it is ``open``, so that the next line goes on with it."""
    upto = Window.partitionBy(*BLOCK).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumn("record", F.sum(F.col("begins").cast("int")).over(upto))
    # most lines are alone and stay where they are
    alone = counted.filter("begins AND NOT open").select("file", "start", "line", F.col("value").alias("text"))
    parts = counted.filter("NOT begins OR open")
    # lines before a block's first beginning go on with the last one of the nearest block before that has any
    ends = counted.groupBy(*BLOCK).agg(F.max("record").alias("last"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("last") > 0, F.struct("start", "last")), ignorenulls=True).over(earlier)
    owners = ends.select(*BLOCK, owner.alias("owner"))
    own = F.struct(F.col("start").alias("start"), F.col("record").alias("last"))
    kept = parts.filter("record > 0").withColumn("owner", own)
    carried = parts.filter("record = 0").join(owners, BLOCK).select(*parts.columns, F.col("owner").alias("owner"))
    order = F.array_sort(F.collect_list(F.struct("start", "line", "value")))
    joined = kept.unionByName(carried).groupBy("file", "owner").agg(order.alias("lines"))
    first = F.get("lines", F.lit(0))
    text = F.aggregate(F.slice("lines", 2, F.size("lines")), first["value"], lambda t, x: F.concat(t, glue, x["value"]))
    return alone.unionByName(joined.select("file", first["start"].alias("start"), first["line"].alias("line"), text.alias("text")))


#: Bytes of a character, and a line break, in encodings in which bytes of other characters may look like one.
WIDE = {"UTF-16LE": (2, "\n\0"), "UTF-16BE": (2, "\0\n"), "UTF-32LE": (4, "\n\0\0\0"), "UTF-32BE": (4, "\0\0\0\n")}

MARKS = {"UTF-32LE": b"\xff\xfe\0\0", "UTF-32BE": b"\0\0\xfe\xff"}


def wide_lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(file, start, size, line, value): the lines of files in an encoding of two or four bytes, in no order. Line breaks are looked for as bytes; one
    that doesn't stand at a whole character is none, which the number of bytes before it tells: by running sums again."""
    width, separator = WIDE[encoding]
    found = blocks(spark, path, separator, "UTF-8")
    pieces = found.select(*BLOCK, F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("value"))
    size = F.octet_length("value") + width
    state = before_block(pieces.groupBy(*BLOCK).agg((F.sum(size) % width).alias("bytes")), bytes_before=F.col("bytes"))
    here = Window.partitionBy(*BLOCK).orderBy("line")
    upto, earlier = here.rowsBetween(Window.unboundedPreceding, Window.currentRow), here.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.join(state, BLOCK).withColumn("open", (F.col("bytes_before") + F.sum(size).over(upto)) % width != 0).withColumn(
        "begins", (F.col("bytes_before") + F.coalesce(F.sum(size).over(earlier), F.lit(0))) % width == 0)
    glue = F.lit(separator).cast("binary")
    text, charset = F.col("text"), encoding
    if width == 4:  # Spark knows UTF-32 by its mark only
        text, charset = F.concat(F.lit(MARKS[encoding]), text), "UTF-32"
    return stitched(placed, glue).select("file", "start", F.lit(0).cast("bigint").alias("size"), "line", F.decode(text, charset).alias("value"))


class QuoteEnds:
    """Lines that end outside quotes."""

    def __init__(self, odd: int):
        self.odd = odd

    def ends(self, data: np.ndarray, stops: np.ndarray) -> np.ndarray:
        quotes = self.odd + np.searchsorted(np.flatnonzero(data == ord('"')), stops)
        self.odd = int(quotes[-1] % 2)
        return quotes % 2 == 0


def csv_records(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(file, head, text): every record of the files; ``head`` marks a file's first one. Records are lines, joined where a
    quote is open; a carriage return before the line break goes. Empty lines outside quotes are no records."""
    lines = wide_lines(spark, path, encoding.upper()) if encoding.upper() in WIDE else blocks(spark, path, "\n", encoding)
    totals = lines.groupBy(*BLOCK).agg((F.sum(times(F.col("value"), '"')) % 2).alias("odd"))
    state = before_block(totals, odd=F.col("odd")).select(*BLOCK, (F.col("odd") % 2).cast("int").alias("odd"))
    whole, edges = cut_texts(lines, stored(state), "\n", QuoteEnds)
    text = F.regexp_replace(F.expr("left(text, length(text) - 1)"), "\r$", "")
    return whole.unionAll(edges).select("file", F.col("first").alias("head"), text.alias("text")).filter(F.col("text") != "")


def header_names(line: str, separator: str) -> list[str]:
    """The names in a header, as Spark makes them: empty ones are _c and their number, repeated ones get it behind them."""
    names = next(csv.reader([line.removeprefix("﻿")], delimiter=separator), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def csv_schema(records: DataFrame, names: list[str], options: dict[str, str]) -> T.StructType:
    """The types of the records' fields, inferred by Spark from all of them."""
    spark = records.sparkSession
    reader = spark.read.options(**{**options, "encoding": "UTF-8", "header": "false", "inferSchema": "true"})
    texts = getattr(records.select("text")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    found = reader._df(reader._jreader.csv(texts)).schema
    kinds = [f.dataType for f in found.fields] + [T.StringType()] * len(names)
    return T.StructType([T.StructField(n, kinds[i]) for i, n in enumerate(names)])


def parsed_records(spark: SparkSession, path: str | list[str], options: dict[str, str], schema: T.StructType | None, corrupt: str) -> tuple[DataFrame, T.StructType]:
    """(fields and, in ``corrupt``, what is malformed of every record; their schema). The first header names the fields; it reaches the driver."""
    records = csv_records(spark, path, options["encoding"])
    rows = records.filter(~F.col("head"))
    if schema is None:
        first = records.filter("head").orderBy("file").select("text").first()
        names = header_names(first["text"], options["sep"]) if first else []
        schema = csv_schema(rows, names, options)
    marked = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    own = {"sep": options["sep"], "escape": options["escape"], "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    shape = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in marked.fields)
    fields = rows.select(F.from_csv("text", shape, own).alias("r"), "text")
    return fields.select("r.*"), schema
