"""Lists of objects in JSON documents, cut into their elements by all tasks at once.

A document is read in segments that end with a closing brace. Whether a segment begins inside a string follows from the number of
quotes before it, and how deep it stands from the brackets outside strings before it. A block doesn't know its state at
the start, so it is summed up for both; running sums over the blocks choose, and the task that reads a block keeps
depth and quotes from segment to segment. An element ends where the depth is back to that of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableglass.sources.blocks import BLOCK, BLOCK_SHAPE, before_block, blocks, by_block, cut_texts, joined_lines, stored

STRING = r'"((?:[^"\\]|\\.)*)"'
#: What stands before the first element, and behind the last one, by the depth of the list.
BEFORE = {1: r"^\s*\[\s*", 2: rf"(?s)^\s*\{{\s*{STRING}\s*:\s*\[\s*"}
BEHIND = {1: r"^\s*\]\s*$", 2: r"^\s*\]\s*\}?\s*$"}
NEXT = r"^\s*,\s*"


#: What a character outside strings adds to the depth; the others of interest are quotes and backslashes.
STEP = np.zeros(256, np.int64)
STEP[[ord(c) for c in "{["]], STEP[[ord(c) for c in "}]"]] = 1, -1
MARKED = STEP != 0
MARKED[ord('"')] = True


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marks, number of quotes before each, its step of depth) of whole segments; marks are brackets and quotes without those behind a
    backslash that counts. Every closing brace ends a segment and is one."""
    at = np.flatnonzero(MARKED[data])
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):
        begins = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
        lengths = np.diff(np.append(begins, len(slashes)))
        behind = (slashes[begins] + lengths)[lengths % 2 == 1]
        at = at[~np.isin(at, behind, assume_unique=True) | (data[at] == ord("}"))]
    marks = data[at]
    quotes = marks == ord('"')
    return marks, np.cumsum(quotes) - quotes, STEP[marks]


class DepthEnds:
    """Segments that end an element: their brace stands outside strings and brings the depth back to that of the list."""

    def __init__(self, inside: int, above: int, depth: int):
        self.inside, self.above, self.depth = inside, above, depth

    def ends(self, data: np.ndarray, stops: np.ndarray) -> np.ndarray:
        marks, quotes, step = structure(data)
        outside = (quotes + self.inside) % 2 == 0
        depth = self.above + np.cumsum(step * outside)
        closing = marks == ord("}")
        self.above, self.inside = int(depth[-1]), int((self.inside + np.count_nonzero(marks == ord('"'))) % 2)
        return (outside & (depth == self.depth))[closing]


def block_totals(segments: DataFrame) -> DataFrame:
    """(file, start, size, odd, if_outside, if_inside): whether a block's quotes are odd, and its change of depth if it begins outside
    a string and if inside one. One row a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, odd, change = None, 0, [0, 0]

        def found() -> Iterator[pa.RecordBatch]:
            if block:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*block, odd, *change)], [*BLOCK, "odd", "if_outside", "if_inside"])
        for key, part in by_block(batches):
            if key != block:
                yield from found()
                block, odd, change = key, 0, [0, 0]
            marks, quotes, step = structure(joined_lines(part.column(len(BLOCK)), b"}")[1])
            change = [c + int(step[(quotes + odd + inside) % 2 == 0].sum()) for inside, c in enumerate(change)]
            odd = int((odd + np.count_nonzero(marks == ord('"'))) % 2)
        yield from found()
    return segments.mapInArrow(run, f"{BLOCK_SHAPE}, odd bigint, if_outside bigint, if_inside bigint")


def json_pieces(spark: SparkSession, path: str | list[str], depth: int) -> DataFrame:
    """(file, first, text, fine): the elements of each file's list at ``depth`` (1: the document, 2: the only member of an object), and what
    is left, with a null text. ``fine`` says that the piece looks as it does in such a list; elements are objects."""
    segments = blocks(spark, path, "}", "UTF-8")
    totals = stored(block_totals(segments))
    inside = totals.join(before_block(totals, inside=F.col("odd")), BLOCK).withColumn("inside", F.col("inside") % 2)
    change = F.when(F.col("inside") == 0, F.col("if_outside")).otherwise(F.col("if_inside"))
    above = F.coalesce(F.sum(change).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = stored(inside.select(*BLOCK, "inside", above.alias("above")))
    whole, edges = cut_texts(segments, state, "}", lambda inside, above: DepthEnds(inside, above, depth))
    start = F.when(F.col("first"), F.lit(BEFORE[depth])).otherwise(F.lit(NEXT))
    stripped = F.regexp_replace("text", start, F.lit(""))
    rest = F.expr("left(text, length(text) - 1)")  # no brace stands behind what is left
    fine = F.when(F.col("ended"), F.regexp_like("text", start) & stripped.startswith("{")).otherwise(F.regexp_like(rest, F.lit(BEHIND[depth])))
    return whole.unionAll(edges).select("file", (F.col("first") & F.col("ended")).alias("first"), F.when(F.col("ended"), stripped).alias("text"), fine.alias("fine"))


def list_files(spark: SparkSession, path: list[str], depth: int) -> list[str]:
    """Those of the files that are such a list from end to end, as Spark names them; one row for each reaches the driver."""
    return judged(json_pieces(spark, path, depth))


def judged(pieces: DataFrame) -> list[str]:
    files = pieces.groupBy("file").agg(F.bool_and("fine").alias("fine"), F.bool_or("first").alias("begun"), F.bool_or(F.col("text").isNull()).alias("closed"))
    return [r["file"] for r in files.filter("fine AND begun AND closed").collect()]


def read_elements(pieces: DataFrame, corrupt: str) -> DataFrame:
    """The elements as rows, with types that Spark infers from all of them."""
    spark, texts = pieces.sparkSession, pieces.filter("text IS NOT NULL").select("text")
    reader = spark.read.option("columnNameOfCorruptRecord", corrupt)
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = reader._df(reader._jreader.json(strings)).schema
    return texts.select(F.from_json("text", schema).alias("r")).select("r.*")  # only the fields asked for are parsed
