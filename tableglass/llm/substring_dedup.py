"""Repeated passages: windows of words repeated at one length alone are extended to twice that length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import small_batches
from tableglass.llm.packed import (NO_ID, Chunk, answer, ask, bits, bucket_bits, by_bucket, chunked, delivered, numbers, sorted_numbers,
                                   squeeze, squeeze_numbers, squeeze_sorted, unsqueeze)
from tableglass.llm.words import window_hashes, word_hashes

STATE = -1  # the message that a chunk keeps for itself: its candidates


class _Words:
    """The words of a chunk, and how many words its document still has from each on."""

    def __init__(self, chunk: Chunk):
        self.hashes, self.starts, _ = word_hashes(chunk.data)
        self.firsts = chunk.firsts(self.starts)
        self.counts = np.diff(self.firsts)
        n = len(self.hashes)
        self.room = np.repeat(self.firsts[1:], self.counts) - np.arange(n)

    def windows(self, at: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
        return window_hashes(self.hashes, size, lane)[at]


def _candidates(words: _Words, mail: dict[int, bytes], size: int, first: int, first_bits: int) -> np.ndarray:
    """Positions where a window of ``size`` words may be repeated: those whose two halves are."""
    if size == first:
        return np.flatnonzero(words.room >= size)
    half = size // 2
    at = _known(words, mail, half, first)
    hashes, back = np.unique(words.windows(at, half), return_inverse=True)
    repeated = np.zeros(len(words.hashes), bool)
    repeated[at] = bits(mail, hashes, first_bits)[back]
    both = np.zeros(len(repeated), bool)
    both[:-half] = repeated[:-half] & repeated[half:]
    return np.flatnonzero(both & (words.room >= size))


def _known(words: _Words, mail: dict[int, bytes], size: int, first: int) -> np.ndarray:
    """The candidates of a length that the chunk has asked about."""
    if size == first:
        return np.flatnonzero(words.room >= size)
    return np.flatnonzero(np.unpackbits(np.frombuffer(unsqueeze(mail[STATE]), np.uint8), count=len(words.hashes)))


def _state(words: _Words, at: np.ndarray) -> tuple[int, bytes]:
    flags = np.zeros(len(words.hashes), np.uint8)
    flags[at] = 1
    return STATE, squeeze(np.packbits(flags))


def _ask_repeated(size: int, first: int, first_bits: int):
    """Sends the 32 bits after the bucket's of each distinct hash, and whether the chunk itself repeats it."""
    def question(chunk: Chunk, mail: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        words = _Words(chunk)
        at = _candidates(words, mail, size, first, first_bits)
        if size > first:
            yield _state(words, at)
        hashes, counts = np.unique(words.windows(at, size), return_counts=True)
        short = ((hashes << np.uint64(first_bits)) >> np.uint64(32)).astype("<u4")
        for bucket, part in by_bucket(hashes, first_bits):
            flags = np.packbits(counts[part] > 1).tobytes()
            yield bucket, (part.stop - part.start).to_bytes(4, "little") + flags + squeeze_sorted(short[part])
    return question


def _reply_repeated(chunks: np.ndarray, bodies: list[bytes]) -> list[bytes]:
    """A bit for each hash: another chunk has it too, or the chunk has it twice."""
    sizes = [int.from_bytes(b[:4], "little") for b in bodies]
    flags = np.concatenate([np.unpackbits(np.frombuffer(b[4:4 + (n + 7) // 8], np.uint8), count=n) for b, n in zip(bodies, sizes)]).astype(bool)
    values = np.concatenate([sorted_numbers(b[4 + (n + 7) // 8:], "<u4") for b, n in zip(bodies, sizes)])
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    out, a = [], 0
    for n in sizes:
        out.append(np.packbits(flags[a:a + n]).tobytes())
        a += n
    return out


def _local_firsts(chunk: Chunk, words: _Words, at: np.ndarray, size: int):
    """(hashes, index of the first occurrence in ``at``, which of ``hashes`` each has): first by id, then row, then position."""
    rank = np.empty(len(chunk.ids), np.int64)
    rank[np.argsort(chunk.ids, kind="stable")] = np.arange(len(chunk.ids))
    doc = np.searchsorted(words.firsts, at, "right") - 1
    order = np.argsort(rank[doc], kind="stable")
    hashes, first, back = np.unique(words.windows(at, size)[order], return_index=True, return_inverse=True)
    of = np.empty(len(at), np.int64)
    of[order] = back
    return hashes, order[first], of, doc


def _ask_first(size: int, first: int, first_bits: int):
    """Sends each distinct hash, 32 bits of a second hash, and the least id that has it here."""
    def question(chunk: Chunk, mail: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        words = _Words(chunk)
        at = _candidates(words, mail, size, first, first_bits)
        yield _state(words, at)
        hashes, firsts, _, doc = _local_firsts(chunk, words, at, size)
        second = (words.windows(at[firsts], size, 1) >> np.uint64(32)).astype("<u4")
        ids = chunk.ids[doc[firsts]]
        for bucket, part in by_bucket(hashes, first_bits):
            low = squeeze_numbers(ids[part])
            yield bucket, len(low).to_bytes(4, "little") + low + second[part].tobytes() + hashes[part].astype("<u8").tobytes()
    return question


def _reply_first(chunks: np.ndarray, bodies: list[bytes]) -> list[bytes]:
    """A bit for each hash: the first window of all is in this chunk."""
    ids, seconds, hashes, sizes = [], [], [], []
    for b in bodies:
        k = 4 + int.from_bytes(b[:4], "little")
        ids.append(numbers(b[4:k], "<i8"))
        n = len(ids[-1])
        seconds.append(np.frombuffer(b[k:k + 4 * n], "<u4"))
        hashes.append(np.frombuffer(b[k + 4 * n:], "<u8"))
        sizes.append(n)
    ids, seconds, hashes, chunk = map(np.concatenate, (ids, seconds, hashes, [np.full(n, c) for n, c in zip(sizes, chunks)]))
    order = np.lexsort((chunk, ids, seconds, hashes))
    h, s = hashes[order], seconds[order]
    flags = np.zeros(len(order), bool)
    flags[order[np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]]] = True
    out, a = [], 0
    for n in sizes:
        out.append(np.packbits(flags[a:a + n]).tobytes())
        a += n
    return out


REMOVED = "id bigint, text string, n_words bigint, n_removed bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, size: int = 20, start: int | None = None, text: str = "text", id_col: str = "doc_id",
                   with_text: bool = True) -> DataFrame:
    """(id, text, n_words, n_removed, kept_sha256): every document without the words of repeated passages.

    Words are what stands between ``[\\x20\\x09-\\x0D]``. A word goes if a window of ``size`` consecutive words covers it that
    also starts earlier: in a document with a smaller id, or earlier in the same one. ``text`` has the other words, joined by
    one space. A null text has no words. A null id is smaller than all others; rows with one id are told apart in a fixed
    order, so that of repeated rows one stays. Other columns are not read. An empty table gives an empty result.

    Windows of ``start`` words come first (``size`` divided by a power of two; by default half of it). Only positions whose
    window is repeated, and so is the one right after it, are asked about at twice that length, until ``size`` is reached or
    no candidate survives. Each round is a shuffle of a chunk's distinct hashes in packed form; the texts stay in chunks.
    """
    start = start or (size // 2 if size % 2 == 0 else size)
    assert size % start == 0 and (size // start).bit_count() == 1, "start times a power of two must be size"
    small_batches(docs.sparkSession)
    first_bits = bucket_bits(docs, text)
    chunks = chunked(docs, id_col, text, "passages")
    length, known = start, chunks
    while length < size:
        asked = ask(known, _ask_repeated(length, start, first_bits), f"windows{length}")
        if asked.filter("bucket >= 0").isEmpty():
            break
        known = delivered(chunks, answer(asked, _reply_repeated), asked.filter("bucket < 0"))
        length *= 2
    none = length < size
    if not none:
        asked = ask(known, _ask_first(size, start, first_bits), f"windows{size}")
        known = delivered(chunks, answer(asked, _reply_first), asked.filter("bucket < 0"))
    else:
        known = chunks.withColumn("mail", F.lit(None).cast("array<struct<bucket:int,body:binary>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(j)[i].as_py() for j in range(5)]
                yield from _without(Chunk(*row[:4]), {m["bucket"]: m["body"] for m in row[4] or ()}, size, first_bits, none, with_text)
    return known.mapInArrow(run, REMOVED).withColumnRenamed("id", id_col)


def _without(chunk: Chunk, mail: dict[int, bytes], size: int, first_bits: int, none: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    words = _Words(chunk)
    n = len(words.hashes)
    gone = np.zeros(n, bool)
    if not none and n:
        at = _known(words, mail, size, 0)
        if len(at):
            hashes, firsts, of, _ = _local_firsts(chunk, words, at, size)
            repeated = np.ones(len(at), bool)
            repeated[firsts[bits(mail, hashes, first_bits)]] = False
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, at[repeated], 1)
            np.add.at(change, at[repeated] + size, -1)
            gone = np.cumsum(change[:-1]) > 0
    kept = ~gone
    lost = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.firsts[:-1]) * (words.counts > 0)
    out = []
    for t, a, b, k in zip(chunk.texts(), words.firsts[:-1].tolist(), words.firsts[1:].tolist(), lost.tolist()):
        own = t.split()
        out.append(b" ".join(compress(own, kept[a:b].tolist()) if k else own))
    for a in range(0, len(out), 2000):
        part, to = out[a:a + 2000], slice(a, a + 2000)
        texts = pa.array([x.decode("utf-8", "replace") for x in part] if with_text else [None] * len(part), pa.string())
        yield pa.RecordBatch.from_arrays([
            chunk.shown_ids()[to], texts, pa.array(words.counts[to], pa.int64()), pa.array(lost[to], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in part])], ["id", "text", "n_words", "n_removed", "kept_sha256"])
