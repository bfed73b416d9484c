"""Benchmark passages in training documents, found through a positional inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import small_batches, stored
from tableglass.llm.packed import CHUNK_BYTES, NO_ID, gathered, id_and_text, numbers, sorted_numbers, squeeze_numbers, squeeze_sorted
from tableglass.llm.words import NOT_ALNUM, word_hashes

BLOCK_BYTES = 2 << 20  # of benchmark text searched for at a time

#: A segment of the index: its documents, where their words begin, and the sorted terms with their numbers of places and places.
SEGMENTS = "segment bigint, ids binary, firsts binary, terms binary, counts binary, places binary"


def build_index(docs: DataFrame, text: str = "text", id_col: str = "doc_id", segment_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The stored index: a row for each segment of about ``segment_bytes`` of text, with the places of every word of every document.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A term's postings are dealt over the
    segments with their documents, so no term, however frequent, gathers in one place.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in gathered(batches, segment_bytes):
            data = b"\n".join(texts)
            words, starts, _ = word_hashes(data, NOT_ALNUM, lower=True)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            firsts = np.r_[np.searchsorted(starts, begins), len(words)].astype("<u4")
            places = np.argsort(words, kind="stable").astype("<u4")  # by term, then by place
            ordered = words[places]
            cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(words) else np.zeros(0, int)
            row = (np.array(ids, "<i8").tobytes(), squeeze_sorted(firsts), ordered[cuts].astype("<u8").tobytes(),
                   squeeze_numbers(np.diff(cuts, append=len(words)).astype("<u4")), squeeze_sorted(places))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in row]], [f.split()[0] for f in SEGMENTS.split(", ")])
    return stored(id_and_text(docs, id_col, text).mapInArrow(run, SEGMENTS), "index")


class Segment:
    def __init__(self, terms: bytes, counts: bytes, wanted: np.ndarray):
        """What a segment has of the wanted terms: their numbers of places."""
        terms, self.counts = np.frombuffer(terms, "<u8"), numbers(counts, "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
        self.has = terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)
        self.at, self.of = at, np.where(self.has, self.counts[at], 0) if len(terms) else np.zeros(len(wanted), np.int64)

    def open(self, ids: bytes, firsts: bytes, places: bytes) -> None:
        self.ids, self.firsts, self.places = np.frombuffer(ids, "<i8"), sorted_numbers(firsts, "<u4").astype(np.int64), sorted_numbers(places, "<u4").astype(np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.firsts))

    def postings(self, term: int) -> np.ndarray:
        """The sorted places of a wanted term."""
        a = self.begin[self.at[term]]
        return self.places[a:a + self.of[term]]


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def _lengths(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many places each wanted term has in all segments; one number a term reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                total += Segment(terms.as_py(), counts.as_py(), wanted).of
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "n"])
    rows = index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(wanted), np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


class Phrases:
    """Phrases as rows of term numbers, by length, each with the names of those who asked for it."""

    def __init__(self, phrases: dict[tuple[int, ...], list[str]]):
        self.terms = np.unique(np.array([t for p in phrases for t in p], np.uint64))
        self.by_length = {}
        for n in sorted({len(p) for p in phrases}):
            own = [p for p in phrases if len(p) == n]
            self.by_length[n] = (np.searchsorted(self.terms, np.array(own, np.uint64)), [phrases[p] for p in own])

    def find(self, s: Segment, rarity: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """(length, starts, names) of every phrase that occurs, from its rarest terms to its most frequent ones."""
        for n, (rows, names) in self.by_length.items():
            for i in np.flatnonzero(s.has[rows].all(axis=1)).tolist():
                row, starts = rows[i], None
                for j in np.argsort(rarity[row], kind="stable").tolist():
                    places = s.postings(row[j])
                    starts = places - j if starts is None else starts[_among(starts + j, places)]
                    if not len(starts):
                        break
                else:
                    starts = starts[starts >= 0]
                    starts = starts[s.doc[starts] == s.doc[starts + n - 1]]
                    if len(starts):
                        yield n, starts, names[i]


def _windows(rows: list, size: int) -> dict[tuple[int, ...], list[str]]:
    out: dict[tuple[int, ...], list[str]] = {}
    for item, text in rows:
        words = word_hashes((text or "").encode(), NOT_ALNUM, lower=True)[0].tolist()
        for a in range(max(1, len(words) - size + 1) if words else 0):
            names = out.setdefault(tuple(words[a:a + size]), [])
            if not names or names[-1] != str(item):
                names.append(str(item))
    return out


HITS = "segment bigint, doc int, id bigint, n_words bigint, spans binary, items array<string>"


def _search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """HITS: every document with the words inside found phrases, as spans, and the names of these."""
    rarity = _lengths(index, phrases.terms) if len(phrases.terms) else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, firsts, terms, counts, places = (batch.column(j)[i].as_py() for j in range(6))
                s = Segment(terms, counts, phrases.terms)
                s.open(ids, firsts, places)
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for n, starts, names in phrases.find(s, rarity):
                    for start, doc in zip(starts.tolist(), s.doc[starts].tolist()):
                        at = start - int(s.firsts[doc])
                        spans.setdefault(doc, []).append((at, at + n))
                        items.setdefault(doc, set()).update(names)
                lengths = np.diff(s.firsts)
                for a in range(0, len(s.ids), 5000):
                    docs = range(a, min(a + 5000, len(s.ids)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array(s.ids[a:a + 5000], pa.int64(), mask=s.ids[a:a + 5000] == NO_ID),
                        pa.array(lengths[a:a + 5000], pa.int64()), pa.array([np.array(spans.get(d, []), "<i8").tobytes() for d in docs], pa.binary()),
                        pa.array([sorted(items.get(d, ())) for d in docs], pa.list_(pa.string()))], [f.split()[0] for f in HITS.split(", ")])
    return index.mapInArrow(run, HITS)


FOUND = "id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<begin:bigint,stop:bigint>>"


def _finish(hits: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, spans, items in zip(batch.column(3), batch.column(4), batch.column(5)):
                pairs, merged = sorted(map(tuple, np.frombuffer(spans.as_py(), "<i8").reshape(-1, 2).tolist())), []
                for a, b in pairs:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                names = sorted(set(items.as_py()))
                hit = sum(b - a for a, b in merged)
                out.append((hit, len(names), names, hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, [{"begin": a, "stop": b} for a, b in merged]))
            if out:
                hit, n, names, sha, bad, spans = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    batch.column(2), batch.column(3), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(sha),
                    pa.array(bad), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])))],
                    ["id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"])
    return hits.mapInArrow(run, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
                  item_id: str = "item_id", index: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, items_sha256, contaminated, spans), one row for each document.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. ``n_hit`` counts the
    document's words inside occurrences of windows, ``spans`` says where they are, ``items`` names the items that own them (a
    null id as ``None``). A null text has no words; a null document id and repeated rows are searched like others; other columns
    are not read. Empty tables give an empty result, or one without hits.

    ``index`` is that of ``build_index``, made here if not given. Windows are searched for in blocks of ``block_bytes`` of
    benchmark text, so the driver and the tasks never hold more of it. A window is looked up from its rarest terms: their places,
    less the term's offset in the window, are intersected until none is left or all terms agree.
    """
    small_batches(docs.sparkSession)
    index = build_index(docs, text, id_col) if index is None else index
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    blocks = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    found = None
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        hits = _search(index, Phrases(_windows([tuple(r) for r in own.collect()], size)))
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("segment", "doc").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.unhex(F.array_join(F.collect_list(F.hex("spans")), "")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"))
    return _finish(found).withColumnRenamed("id", id_col)


def proximity(index: DataFrame, phrases: DataFrame, slop: int, phrase_id: str = "phrase_id", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, phrase_id, place): where all words of a phrase stand close together in one document, in any order: at ``place`` is its
    rarest word, and every other word is found within ``slop`` words of it. ``phrases`` is a set small enough for the driver."""
    asked: dict[tuple[int, ...], list[str]] = {}
    for name, t in phrases.select(phrase_id, text).collect():
        words = tuple(dict.fromkeys(word_hashes((t or "").encode(), NOT_ALNUM, lower=True)[0].tolist()))
        if words:
            asked.setdefault(words, []).append(str(name))
    wanted = Phrases(asked)
    rarity = _lengths(index, wanted.terms) if asked else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, firsts, terms, counts, places = (batch.column(j)[i].as_py() for j in range(6))
                s = Segment(terms, counts, wanted.terms)
                s.open(ids, firsts, places)
                for rows, names in wanted.by_length.values():
                    for r in np.flatnonzero(s.has[rows].all(axis=1)).tolist():
                        first, *others = rows[r][np.argsort(rarity[rows[r]], kind="stable")].tolist()
                        at = s.postings(first)
                        low, high = np.maximum(at - slop, s.firsts[s.doc[at]]), np.minimum(at + slop, s.firsts[s.doc[at] + 1] - 1)
                        for term in others:
                            p = s.postings(term)
                            near = np.searchsorted(p, low) < np.searchsorted(p, high, "right")
                            at, low, high = at[near], low[near], high[near]
                        doc = s.doc[at]
                        for name in names[r] if len(at) else ():
                            yield pa.RecordBatch.from_arrays([
                                pa.array(s.ids[doc], pa.int64(), mask=s.ids[doc] == NO_ID), pa.array([name] * len(at)), pa.array(at - s.firsts[doc], pa.int64())], ["id", "phrase_id", "place"])
    return index.mapInArrow(run, "id bigint, phrase_id string, place bigint").withColumnsRenamed({"id": id_col})
