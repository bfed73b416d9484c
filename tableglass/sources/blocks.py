"""Texts that go over many lines, cut out of files by all tasks at once.

Spark reads a file in blocks, and a task sees the lines of a block in order. Where a text ends follows from a small state (inside quotes,
depth of brackets); that at the start of each block is known from totals of the blocks before. So a task goes through its
lines once, keeps the state, and gives out whole texts as they stand in Arrow's buffer. Only what stands before the first end and behind the last end of each block
is put together with other blocks' pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableglass.plans.scratch import stored

#: A block: a file, and the first byte and the length of what one task reads of it at a time.
BLOCK = ["file", "start", "size"]
BLOCK_SHAPE = "file string, start bigint, size bigint"
WHOLE, HEAD, TAIL = range(3)


def blocks(spark: SparkSession, path: str | list[str], separator: str, encoding: str) -> DataFrame:
    """(file, start, size, value): what stands between separators, in reading order within each block."""
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size")
    value = F.col("value") if encoding.upper() in ("UTF-8", "US-ASCII") else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.option("lineSep", separator).text(path).select(*at, value.alias("value"))


def joined_lines(values: pa.Array, separator: bytes) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """(buffer, bytes, where each line ends) of lines with the separator behind each."""
    ended = pc.binary_join_element_wise(values.cast(pa.binary()), pa.scalar(b"", pa.binary()), pa.scalar(separator, pa.binary()))
    _, offsets, content = ended.buffers()
    stops = np.frombuffer(offsets, np.int32, len(ended) + 1, ended.offset * 4)[1:]
    return content, np.frombuffer(content, np.uint8, stops[-1]), stops


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(block, lines) of each batch's blocks, in order."""
    for batch in batches:
        n, keys = batch.num_rows, [batch.column(i) for i in range(len(BLOCK))]
        if not n:
            continue
        cuts = [0, n]
        if any(k[0] != k[n - 1] for k in keys):
            differ = [pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False) for k in keys]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce(differ)) + 1), n]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            yield tuple(part.column(i)[0].as_py() for i in range(len(BLOCK))), part


def block_texts(placed: DataFrame, separator: str, ends: Callable, kinds: Sequence[int]) -> DataFrame:
    """(file, start, size, kind, text): texts cut out block by block, each line with its separator behind it, the kinds asked for.

    ``placed`` has the lines in order, and the block's state behind ``value``; ``ends(*state)`` is an object whose ``ends(bytes, stops)``
    says of lines, one batch after another, whether a text ends with them.
    """
    shape, glue = f"{BLOCK_SHAPE}, kind int, text string", separator.encode()

    def rows(block: tuple, kind: int, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        keys = [pa.repeat(pa.scalar(v, t), n) for v, t in zip((*block, kind), (pa.string(), pa.int64(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*keys, texts], [*BLOCK, "kind", "text"])

    def one(block: tuple, kind: int, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        if pieces and kind in kinds:
            yield rows(block, kind, pa.Array.from_buffers(pa.string(), 1, pa.array([b"".join(pieces)], pa.binary()).buffers()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pending = None, []
        for key, part in by_block(batches):
            if key != block:
                yield from one(block, TAIL, pending)
                state = [part.column(i)[0].as_py() for i in range(len(BLOCK) + 1, part.num_columns)]
                if None in state:
                    raise ValueError(f"{key[0]} was read in other blocks, or changed, between two passes")
                block, pending, begun, scanner = key, [], False, ends(*state)
            content, data, stops = joined_lines(part.column(len(BLOCK)), glue)
            at = stops[scanner.ends(data, stops)]
            if not len(at):
                pending.append(data.tobytes())
                continue
            if pending or not begun:
                pending.append(data[:at[0]].tobytes())
                yield from one(block, WHOLE if begun else HEAD, pending)
            else:
                at = np.concatenate(([0], at))
            if len(at) > 1 and WHOLE in kinds:
                yield rows(block, WHOLE, pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), content]))
            begun, pending = True, [data[at[-1]:].tobytes()] if at[-1] < len(data) else []
        yield from one(block, TAIL, pending)
    return placed.mapInArrow(run, shape)


def cut_texts(lines: DataFrame, state: DataFrame, separator: str, ends: Callable) -> tuple[DataFrame, DataFrame]:
    """Two tables of (file, first, ended, text): texts that stand whole within a block, and those put together from blocks' ends. ``first`` is a file's
    first one; one that is not ``ended`` is what is left at the end of a file. Each line has its separator behind it. ``state`` has a row
    for each block, is stored and small."""
    placed = lines.join(F.broadcast(state), BLOCK, "left")
    if "line" in lines.columns:  # the lines are not in order
        placed = placed.repartition("file", "start").sortWithinPartitions(*BLOCK, "line")
    placed = placed.select(*BLOCK, "value", *state.columns[len(BLOCK):])
    pieces = stored(block_texts(placed, separator, ends, (HEAD, TAIL)))  # two rows a block
    before = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("text_number", F.coalesce(F.sum((F.col("kind") == HEAD).cast("int")).over(before), F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    parts = numbered.groupBy("file", "text_number").agg(order.alias("pieces"), F.max((F.col("kind") == HEAD)).alias("ended"))
    edges = parts.select("file", (F.col("text_number") == 0).alias("first"), "ended", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))
    whole = block_texts(placed, separator, ends, (WHOLE,)).select("file", F.lit(False).alias("first"), F.lit(True).alias("ended"), "text")
    return whole, edges


def before_block(totals: DataFrame, **sums) -> DataFrame:
    """(file, start, size, ...): each sum over all earlier blocks of the file; one row a block."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*BLOCK, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for name, c in sums.items()])
