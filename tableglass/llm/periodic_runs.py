"""Runs of words that repeat with a period, found by a sparse dynamic program over diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import small_batches
from tableglass.llm.words import mix, window_hashes, word_hashes

LEAST = 12  # words of a run
PART = 4 << 20  # bytes of texts looked at together; a longer one alone
BLOCK = 1 << 20  # pairs of words compared at a time

SHAPE = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _same(order_keys: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once, ascending."""
    order = np.argsort(order_keys)
    s = order_keys[order]
    twin = np.r_[False, s[1:] == s[:-1]]
    return np.sort(order[twin | np.r_[twin[1:], False]]) if len(s) else order


def _openings(words: np.ndarray, keys: np.ndarray, at: np.ndarray, window: int, low: int, high: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the cells where a diagonal of lag i - j in [low, high) begins that will reach max(lag, least - lag) words.

    ``keys`` hashes the window that begins at each word, ``at`` are the places whose key occurs again. An earlier occurrence at most half a window
    back makes a chain: the window has that period, so all of a chain but its head follow the same word. A diagonal begins where
    the words before differ, so at the head of a chain, on one side or the other; and inside a chain only at its own period,
    as longer lags there repeat the same stretch.
    """
    order = at[np.argsort(keys[at], kind="stable")]
    k = keys[order]
    fresh = np.r_[True, k[1:] != k[:-1]]
    step = np.r_[0, np.diff(order)]
    chained = ~fresh & (2 * step <= window)
    group, chain = np.cumsum(fresh), np.cumsum(~chained)
    size = len(words) + 1
    place = group * size + order
    heads = np.flatnonzero(~chained)
    found = []
    for who, among in ((heads, np.arange(len(order))), (np.flatnonzero(chained), heads)):
        base, i = group[who] * size, order[who]
        first = np.searchsorted(place[among], base + np.maximum(i - high + 1, 0))
        count = np.maximum(np.searchsorted(place[among], base + i - low, "right") - first, 0)
        left = np.repeat(who, count)
        right = among[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)]
        found.append((left, right))
    left, right = (np.concatenate(x) for x in zip(*found))
    i, j = order[left], order[right]
    lag = i - j
    keep = (words[i - 1] != words[j - 1]) & ((chain[left] != chain[right]) | (lag == step[left]))
    i, j, lag = i[keep], j[keep], lag[keep]
    # two windows cover the words that must match
    ahead = np.maximum(lag, least - lag) - window
    inside = i + ahead < len(keys)
    i, j, ahead = i[inside], j[inside], ahead[inside]
    long = keys[i + ahead] == keys[j + ahead]
    return i[long], j[long]


def _lengths(words: np.ndarray, i: np.ndarray, j: np.ndarray, known: int) -> np.ndarray:
    """How many words match from i and j on: all open diagonals advance together, each until its first mismatch."""
    length, open_, step = np.full(len(i), known), np.arange(len(i)), 64
    last = len(words) - 1
    while len(open_):
        rest = []
        for a in range(0, len(open_), max(1, BLOCK // step)):
            some = open_[a:a + max(1, BLOCK // step)]
            place = length[some, None] + np.arange(step)
            same = words[np.minimum(i[some, None] + place, last)] == words[np.minimum(j[some, None] + place, last)]
            ended = ~same.all(axis=1)
            length[some] += np.where(ended, same.argmin(axis=1), step)
            rest.append(some[~ended])
        open_, step = np.concatenate(rest), min(step * 2, BLOCK)
    return length


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, given as its words' hashes: rows (start, length, period) of its runs, by start, then period.

    The dynamic program's cell for a word and a lag is the number of words up to it that equal those ``lag`` earlier: one more
    than the cell before if the word occurred there, else 0. A diagonal that ends with max(lag, least - lag) words or more is a
    stretch of that period. Only diagonals that get so long are opened: an earlier occurrence counts if a
    whole window of words occurs there, and for lags from 8 on in octaves, of ``low`` words for lags in [low, 2 * low). Texts without a
    window that occurs twice take no part in higher octaves. Of diagonals that give the same stretch the least lag is its period.
    """
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    left = [t for t in range(len(texts)) if len(texts[t]) >= least]
    half = least // 2
    found: list[tuple[np.ndarray, ...]] = []
    low, high = 1, max(8, half + 2)
    while left:
        window = half if low == 1 else low
        left = [t for t in left if len(texts[t]) >= max(least, 2 * low)]
        if not left:
            break
        # a mark that equals nothing before, between and behind the texts
        marks = mix(np.arange(1, len(left) + 2, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        words = np.concatenate([marks[:1], *[x for n, t in enumerate(left) for x in (texts[t], marks[n + 1:n + 2])]])
        lengths = np.array([len(texts[t]) + 1 for t in left])
        begins = np.cumsum(np.r_[1, lengths])[:-1]
        if len(words) < window:
            break
        keys = window_hashes(words, window)
        doc = np.repeat(np.arange(len(left), dtype=np.uint64), lengths)
        doc = np.r_[np.uint64(0), doc][:len(keys)]
        keys = keys + mix(doc + np.uint64(1))  # only occurrences in the same text count
        at = _same(keys)
        if not len(at):
            break
        i, j = _openings(words, keys, at, window, low, high, least)
        if len(i):
            length = _lengths(words, i, j, window)
            whose = np.searchsorted(begins, j, "right") - 1
            found.append((np.array(left)[whose], j - begins[whose], i - j + length, i - j))
        left = [left[t] for t in np.unique(doc[at].astype(np.int64)).tolist()]
        low, high = high, 2 * high
    if not found:
        return out
    text, start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    first = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
    text, rows = text[first], np.stack([start[first], length[first], period[first]], axis=1)
    rows = rows[order := np.lexsort((rows[:, 2], rows[:, 0], text))]
    text = text[order]
    cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        out[text[a]] = rows[a:b]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Marks the words that stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _parts(texts: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1])
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def _judged(part: list[bytes], least: int) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    data = b"\n".join(part)
    hashes, starts, ends = word_hashes(data)
    begins = np.cumsum([0] + [len(t) + 1 for t in part])
    cuts = np.searchsorted(starts, begins)
    runs = runs_of([hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])], least)
    texts = []
    for t, a, b, r in zip(part, cuts[:-1].tolist(), cuts[1:].tolist(), runs):
        if not len(r):
            texts.append(b" ".join(t.split()))
            continue
        at = a + np.flatnonzero(kept_words(b - a, r))
        texts.append(b" ".join([data[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())]))
    return np.diff(cuts).tolist(), runs, texts


def find_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """The rows with ``n_words``, ``runs`` and ``collapsed``; columns of those names are replaced.

    Words are what white space (\\x20 and \\x09-\\x0D) parts. A run is a stretch of words with smallest period q and a length of
    at least max(``least``, 2 * q) that no neighbouring word extends; ``least`` is 12 or more. ``runs`` lists (start, length, period) by start, then period.
    ``collapsed`` is the text without the words that a run holds after its first q words, the others joined by one space. A
    null text has no words, no runs and collapses to an empty text, as does an empty one. Each row is judged by itself, repeated
    rows alike; an empty table gives an empty result. A text is one task's work: some 150 bytes of memory for each of its words.
    """
    if least < 12:
        raise ValueError("runs of fewer than 12 words are not looked for")
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed")
    shape = docs.sparkSession.createDataFrame([], SHAPE).schema
    schema = docs.limit(0).schema
    for f in shape.fields:
        schema = schema.add(f)
    at = docs.columns.index(text)
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin = 0
            for part in _parts(b.column(at).fill_null("").cast(pa.binary())):
                n, runs, collapsed = _judged(part, least)
                rows = np.concatenate(runs)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(rows[:, c], pa.int64()) for c in range(3)], fields=list(entry)))
                own = b.slice(begin, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n, pa.int64()), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)
                begin += len(part)
    return docs.mapInArrow(run, schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What a report needs of each row of :func:`find_runs`: the longest run (ties: least start, then period) and SHA-256 sums."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts of which a tenth, chosen by h = crc32 of the id, repeat from one word on: with g = h div 10 and n words, word i from a =
    g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8), and the words are joined by one space. The others
    stay as they are, as do texts without words."""
    t, h = F.col(text), F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    words = F.regexp_extract_all(t, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))

    def repeated(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")).otherwise(t)
    whole = F.element_at(F.transform(F.array(words), repeated), 1)  # the words are made once
    return docs.withColumn(text, F.when(t.isNotNull() & (h % 10 == 0), whole).otherwise(t))
