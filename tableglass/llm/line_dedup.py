"""Lines that many documents share, dropped by way of compressed keep bitmaps, one a document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableglass.llm.common import ascii_lower, give_back, small_batches, stored

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def sorted_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, id, place, pos) of every line whose key has ``least_chars`` code points, range-partitioned and sorted by the
    key's hash of 128 bits, then the document, then the position. The document counts in the ranges, so a key that a third of
    all documents hold is spread over many tasks."""
    lines = docs.select("id", "place", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    hashed = lines.filter(F.length("key") >= least_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "place", "pos")
    order = ["h1", "h2", "id", "place"]
    return hashed.repartitionByRange(*order).sortWithinPartitions(*order, "pos")


#: A line to drop; or, with key, one to drop if the key's documents in all tasks together are enough; or such a count.
STREAMED = "id bigint, place bigint, pos int, h1 bigint, h2 bigint, docs bigint, started boolean"
NAMES = [f.split()[0] for f in STREAMED.split(", ")]


class _Run:
    """The lines of one key in one task, seen bit by bit. A run at the start of a task may go on from the task before, so its
    lines are not settled here. Other lines wait until the key has documents enough, then they are dropped at once."""

    def __init__(self, key: tuple[int, int], first: bool, least_docs: int, keep_first: bool):
        self.key, self.first, self.least, self.skip = key, first, least_docs, keep_first and not first
        self.docs, self.doc, self.held = 0, None, []

    def add(self, lines: dict[str, np.ndarray], docs: int) -> Iterator[pa.RecordBatch]:
        n = len(lines["pos"])
        self.docs += docs - (self.doc == (int(lines["id"][0]), bool(lines["null"][0])))
        self.doc = (int(lines["id"][n - 1]), bool(lines["null"][n - 1]))
        if self.skip:
            lines, self.skip = {k: v[1:] for k, v in lines.items()}, False
        if self.first:
            yield _lines(lines, self.key)
            return
        self.held.append(lines)
        if self.docs >= self.least:
            yield from self.release(None)

    def release(self, key: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
        for lines in self.held:
            yield _lines(lines, key)
        self.held = []

    def close(self, last: bool) -> Iterator[pa.RecordBatch]:
        if last:
            yield from self.release(self.key)
        if last or self.first:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([self.key[0]], pa.int64()),
                pa.array([self.key[1]], pa.int64()), pa.array([self.docs], pa.int64()), pa.array([not self.first])], NAMES)


def _lines(lines: dict[str, np.ndarray], key: tuple[int, int] | None) -> pa.RecordBatch:
    n = len(lines["pos"])
    h = [pa.array(np.full(n, k), pa.int64()) for k in key] if key else [pa.nulls(n, pa.int64())] * 2
    return pa.RecordBatch.from_arrays([
        pa.array(lines["id"], pa.int64(), mask=lines["null"]), pa.array(lines["place"], pa.int64()), pa.array(lines["pos"], pa.int32()),
        *h, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], NAMES)


def _stream(batches: Iterator[pa.RecordBatch], least_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Walks the sorted lines of one task and holds no more than the undecided lines of one key."""
    run, any_yet = None, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(2)
        data = {"id": np.asarray(ids.fill_null(0)), "null": np.asarray(ids.is_null()), "place": np.asarray(batch.column(3)), "pos": np.asarray(batch.column(4))}
        h1, h2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_key | np.r_[True, (data["id"][1:] != data["id"][:-1]) | (data["null"][1:] != data["null"][:-1])]
        starts = np.flatnonzero(new_key)
        ends, docs = np.r_[starts[1:], n], np.add.reduceat(new_doc.astype(np.int64), starts)
        last = len(starts) - 1
        for i in dict.fromkeys((0, last)):  # the first may go on from the batch before, the last into the next one
            if i == last > 0:  # those between begin and end here
                between = np.repeat(docs >= least_docs, ends - starts) & ~(new_key & keep_first)
                between[:ends[0]] = between[starts[last]:] = False
                if between.any():
                    yield _lines({k: v[between] for k, v in data.items()}, None)
            key = (int(h1[starts[i]]), int(h2[starts[i]]))
            if run is None or run.key != key:
                if run is not None:
                    yield from run.close(last=False)
                run, any_yet = _Run(key, not any_yet, least_docs, keep_first), True
            yield from run.add({k: v[starts[i]:ends[i]] for k, v in data.items()}, int(docs[i]))
    if run is not None:
        yield from run.close(last=True)


def _bitmap(positions: np.ndarray) -> bytes:
    """Compressed bits, one a line at least up to the last dropped one; 1: keep."""
    keep = np.ones((int(positions.max()) // 8 + 1) * 8, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def _kept(lines: list[str], bitmap: bytes | None) -> list[str]:
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(keep) or keep[i]]


def keep_bitmaps(docs: DataFrame, least_docs: int, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(id, place, bitmap) of the documents that lose lines. ``docs`` has (id, place, text)."""
    small_batches(docs.sparkSession)
    streamed = stored(sorted_lines(docs, least_chars).mapInArrow(lambda b: _stream(b, least_docs, keep_first), STREAMED), "lines")
    # two counts a task at most
    edges = streamed.filter("docs IS NOT NULL").groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("started").alias("begun"))
    edges = stored(edges.filter(F.col("all_docs") >= least_docs), "edges")
    settled = streamed.filter("h1 IS NULL").select("id", "place", "pos")
    line = F.struct("id", "place", "pos")
    waiting = streamed.filter("docs IS NULL AND h1 IS NOT NULL").drop("docs", "started").join(F.broadcast(edges.drop("all_docs")), ["h1", "h2"])
    if keep_first:  # the first line of a key that begins just where a task begins
        firsts = waiting.filter(~F.col("begun")).groupBy("h1", "h2").agg(F.min(line).alias("first"))
        waiting = waiting.join(F.broadcast(firsts), ["h1", "h2"], "left").filter(F.col("first").isNull() | (line != F.col("first")))
    dropped = settled.unionByName(waiting.select("id", "place", "pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [_bitmap(np.asarray(x.values)) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["id", "place", "bitmap"])
    # a list is no longer than its document
    return dropped.groupBy("id", "place").agg(F.collect_list("pos").alias("positions")).mapInArrow(pack, "id bigint, place bigint, bitmap binary")


def drop_shared_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False,
                      text: str = "text", id_col: str = "doc_id", carry: Sequence[str] = (), most: float = 1.0) -> DataFrame:
    """(id, place, text, n_lines, n_dropped, bitmap, kept_sha256, carried): one row for each document.

    Lines are split at \\n. A line whose key (white space stripped at both ends, A-Z lower-cased) has at least ``least_chars``
    code points and is found in at least ``least_docs`` documents is dropped everywhere; ``keep_first`` leaves the first such
    line of the corpus, in the order of ids and positions. ``bitmap`` has a zlib-compressed bit for each line, null where all
    stay; ``place`` tells rows of one id apart; ``carried`` has the
    columns named in ``carry``. A document that would lose more than the share ``most`` of its characters keeps all its lines. Null and empty texts are one empty line. Rows with equal ids (null is an id too)
    count as one document. Other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("place"), body.alias("text"),
                       F.struct(F.lit(1).alias("__"), *[F.col(f"`{c.replace('`', '``')}`") for c in carry]).alias("carried"))
    bitmaps = keep_bitmaps(docs, least_docs, least_chars, keep_first).withColumnsRenamed({"id": "b_id", "place": "b_place"})
    joined = docs.join(bitmaps, (F.col("place") == F.col("b_place")) & F.col("id").eqNullSafe(F.col("b_id")), "left").select("id", "place", "text", "bitmap", "carried")
    shape = T.StructType.fromDDL("id bigint, place bigint, text string, n_lines bigint, n_dropped bigint, bitmap binary, kept_sha256 string").add(
        "carried", joined.schema["carried"].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, m in zip(b.column(2), b.column(3)):
                lines = t.as_py().split("\n")
                kept = _kept(lines, m.as_py())
                whole = "\n".join(kept)
                if most < 1 and len(whole) < (1 - most) * len(t.as_py()):
                    kept, whole = lines, t.as_py()
                out.append((whole, len(lines), len(lines) - len(kept), hashlib.sha256(whole.encode()).hexdigest()))
            if out:
                texts, n, lost, sha = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), b.column(3),
                    pa.array(sha, pa.string()), b.column(4)], ["id", "place", "text", "n_lines", "n_dropped", "bitmap", "kept_sha256", "carried"])
                del out, texts
                give_back()
    return joined.mapInArrow(apply, shape).withColumnRenamed("id", id_col)
