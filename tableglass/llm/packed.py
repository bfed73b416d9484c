"""Texts in chunks of some MB, and questions that chunks ask of all others by shuffling packed arrays instead of rows.

A chunk's distinct hashes are dealt out by their first bits into buckets, so that a hash, however frequent, arrives once a
chunk; the bucket's task answers with one bit or number for each, and the answers meet their chunk in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import small_batches, stored

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of text for each bucket
MOST_ROWS = 1 << 20  # of a chunk, however short its texts
NO_ID = -(1 << 63)  # stands for a null id

CHUNKS = "chunk bigint, ids binary, lengths binary, body binary"
MESSAGES = "chunk bigint, bucket int, body binary"
NAMES = ["chunk", "bucket", "body"]


def squeeze(a: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a if isinstance(a, bytes) else a.tobytes())


def unsqueeze(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def squeeze_numbers(a: np.ndarray) -> bytes:
    """Integers by planes of bytes, so that their common high bytes take no room."""
    a = np.ascontiguousarray(a)
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T))


def numbers(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueeze(b), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze_numbers(np.diff(a, prepend=a.dtype.type(0)))


def sorted_numbers(b: bytes, kind: str) -> np.ndarray:
    return np.cumsum(numbers(b, kind), dtype=kind)


class Chunk:
    """Some documents: their ids (NO_ID for null), and their texts in UTF-8 one after another with a line break between."""

    def __init__(self, chunk: int, ids: bytes, lengths: bytes, body: bytes):
        self.chunk, self.ids, self.lengths = chunk, np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
        self.data = unsqueeze(body)
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1  # of each text in data

    def texts(self) -> Iterator[bytes]:
        for a, n in zip(self.begins.tolist(), self.lengths.tolist()):
            yield self.data[a:a + n]

    def firsts(self, starts: np.ndarray) -> np.ndarray:
        """The number of each text's first word, and of the end, for the words that begin at ``starts``."""
        return np.r_[np.searchsorted(starts, self.begins), len(starts)]

    def shown_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)


def gathered(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(number, ids, texts) of each chunk that a task makes of its rows (id, text)."""
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(NO_ID if i is None else i)
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= chunk_bytes or len(ids) == MOST_ROWS:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def id_and_text(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def chunked(docs: DataFrame, id_col: str, text: str, name: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents in stored chunks of about ``chunk_bytes``; a longer text is a chunk of its own."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in gathered(batches, chunk_bytes):
            lengths = np.array([len(t) for t in texts], "<i8")
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([lengths.tobytes()]),
                pa.array([squeeze(b"\n".join(texts), 3)])], ["chunk", "ids", "lengths", "body"])
    return stored(id_and_text(docs, id_col, text).mapInArrow(run, CHUNKS), name)


def bucket_bits(docs: DataFrame, text: str) -> int:
    """So many first bits of a hash choose its bucket: a bucket for each BUCKET_BYTES of text, a power of two."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(0, int(size // BUCKET_BYTES).bit_length())


def by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets that have some of the sorted hashes, and where they are."""
    if not len(hashes):
        return
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(hashes)]):
        yield int(buckets[a]), slice(a, b)


def message(chunk: int, bucket: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], NAMES)


def ask(chunks: DataFrame, question: Callable[..., Iterator[tuple[int, bytes]]], name: str | None = None, make: Callable | None = None) -> DataFrame:
    """Each chunk's messages (bucket, body), stored if there is a name. Messages to buckets below 0 are kept for the chunk itself. ``chunks``: with
    a column ``mail`` of messages to the chunk, if there are any yet. The question gets the chunk and its mail, or what ``make``
    makes of the row and the mail."""
    has_mail = "mail" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(j)[i].as_py() for j in range(batch.num_columns)]
                mail = {m["bucket"]: m["body"] for m in row[4] or ()} if has_mail else {}
                out = list(question(make(row, mail)) if make else question(Chunk(*row[:4]), mail))
                for a in range(0, len(out), 64):
                    part = out[a:a + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row[0]] * len(part), pa.int64()), pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.binary())], NAMES)
    messages = chunks.mapInArrow(run, MESSAGES)
    return stored(messages, name) if name else messages


def answer(messages: DataFrame, reply: Callable[[np.ndarray, list[bytes]], list[bytes]]) -> DataFrame:
    """Each bucket's answers, a body for each message it got: (chunk, bucket, body). ``reply`` gets the chunks and bodies. One
    body more is a fact about the bucket, for chunk -1."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        bodies = reply(np.asarray(group.column(0)), group.column(2).to_pylist())
        chunks, buckets = group.column(0).to_pylist(), group.column(1).to_pylist()
        if len(bodies) > len(chunks):
            chunks, buckets = [*chunks, -1], [*buckets, buckets[0]]
        return pa.table([pa.array(chunks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], names=NAMES)
    return messages.filter("bucket >= 0").groupBy("bucket").applyInArrow(run, MESSAGES)


def delivered(chunks: DataFrame, *mail: DataFrame) -> DataFrame:
    """The chunks with a column ``mail`` of all messages to them; a chunk gets a few small ones from each bucket."""
    every = mail[0]
    for m in mail[1:]:
        every = every.unionByName(m)
    lists = every.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias("mail"))
    return chunks.join(lists, "chunk", "left")


def bits(mail: dict[int, bytes], hashes: np.ndarray, first_bits: int) -> np.ndarray:
    """The bit that was answered for each of the sorted hashes."""
    out = np.zeros(len(hashes), bool)
    for bucket, at in by_bucket(hashes, first_bits):
        out[at] = np.unpackbits(np.frombuffer(mail[bucket], np.uint8), count=at.stop - at.start)
    return out
