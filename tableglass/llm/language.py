"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import give_back, small_batches, stored

DIMENSION = 1024
GRAM = 3
UNKNOWN = "und"
MAX_LANGUAGES = 10_000  # so that profiles never exceed 80 MB; more distinct values are an error
SLICE = 4096  # distinct n-grams turned into vectors at a time
PART = 1 << 20  # code points of texts turned into vectors at a time


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            table[p] = ord(low) if len(low) == 1 else p
    return table


@lru_cache(maxsize=20_000)
def letter_vector(point: int) -> np.ndarray:
    """The letter's random vector of 1 and -1, the same everywhere."""
    return np.random.Generator(np.random.Philox(key=point)).integers(0, 2, DIMENSION, dtype=np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The n-grams' vectors: the letters' vectors, rotated by their distance to the n-gram's end, multiplied. ``grams``: numbers
    of letters in ``alphabet``, a row for each n-gram."""
    base = np.stack([letter_vector(int(p)) for p in alphabet])
    out = np.ones((len(grams), DIMENSION), np.int8)
    for j in range(GRAM):
        out *= np.roll(base, GRAM - 1 - j, axis=1)[grams[:, j]]
    return out.astype(np.float32)


def bundles(row: np.ndarray, gram: np.ndarray, n: np.ndarray, rows: int, grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The sum of the n-grams' vectors, each n times, for each of ``rows`` rows. Goes through the distinct n-grams in slices, so that memory
    doesn't grow with their number: letters of Chinese or Japanese have millions of trigrams."""
    total = np.zeros((rows, DIMENSION), np.float32)
    order = np.argsort(gram, kind="stable")
    row, gram, n = row[order], gram[order], n[order]
    for a in range(0, len(grams), SLICE):
        part = slice(*np.searchsorted(gram, [a, a + SLICE]))
        some = grams[a:a + SLICE]
        letters_of, own = np.unique(some, return_inverse=True)
        counts = np.zeros((rows, len(some)), np.float32)
        np.add.at(counts, (row[part], gram[part] - a), n[part])
        total += counts @ gram_vectors(own.reshape(some.shape), alphabet[letters_of])
    return total


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count), the grams and the alphabet: letters lower-cased, each run of others one gap, which also stands
    at both ends. Documents without letters have no grams."""
    lengths = np.array([len(t) for t in texts])
    joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    s = letters()[joined]
    doc = np.repeat(np.arange(len(texts)), lengths + (np.arange(len(texts)) < len(texts) - 1))
    # a gap before the first text and after the last; between texts stands a line break already
    s, doc = np.r_[np.uint32(0), s, np.uint32(0)], np.r_[0, doc, len(texts) - 1]
    keep = np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]
    s, doc = s[keep], doc[keep]
    alphabet, letter = np.unique(s, return_inverse=True)
    if len(s) < GRAM:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, GRAM), int), alphabet
    k = len(alphabet)
    window = np.stack([letter[j:len(letter) - GRAM + 1 + j] for j in range(GRAM)], axis=1)
    middle = doc[1:len(doc) - GRAM + 2]
    fine = np.ones(len(window), bool)
    for j in range(1, GRAM - 1):
        fine &= s[j:len(s) - GRAM + 1 + j] != 0  # a gap in the middle would join two words
    codes = np.zeros(len(window), np.int64)
    for j in range(GRAM):
        codes = codes * k + window[:, j]
    codes, middle = codes[fine], middle[fine]
    if k ** GRAM <= 1 << 23:
        present = np.flatnonzero(np.bincount(codes, minlength=k ** GRAM))
        number = np.empty(k ** GRAM, np.int64)
        number[present] = np.arange(len(present))
        gram = number[codes]
    else:
        present, gram = np.unique(codes, return_inverse=True)
    pairs, n = np.unique(middle * max(len(present), 1) + gram, return_counts=True)
    grams = np.stack([present // k ** (GRAM - 1 - j) % k for j in range(GRAM)], axis=1)
    return pairs // max(len(present), 1), pairs % max(len(present), 1), n, grams, alphabet


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about PART code points; a longer one alone."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PART or i - a >= 500:
            yield a, [x or "" for x in texts[a:i + 1]]
            a, size = i + 1, 0
    if a < len(texts):
        yield a, [x or "" for x in texts[a:]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The profile of each language, of unit length: the sum of the vectors of all n-grams of its texts. Rows without a text or
    a language teach nothing."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, part in _parts(texts):
                doc, gram, n, grams, alphabet = gram_counts(part)
                if not len(n):
                    continue
                names, of = np.unique(np.array(langs[a:a + len(part)], object).astype(str), return_inverse=True)
                for name, v in zip(names.tolist(), bundles(of[doc], gram, n, len(names), grams, alphabet)):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
                del doc, gram, n, grams
            give_back()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([TaskContext.get().partitionId() % 64] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()])], ["lang", "salt", "vector"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in group.column("vector"))
        return pa.table({"lang": group.column("lang").slice(0, 1), "salt": group.column("salt").slice(0, 1), "vector": pa.array([total.tobytes()])})
    shape = "lang string, salt int, vector binary"
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = known.mapInArrow(run, shape).groupBy("lang", "salt").applyInArrow(add, shape)
    sums = stored(sums.groupBy("lang").applyInArrow(add, shape), "profiles")
    rows = sums.limit(MAX_LANGUAGES + 1).collect()  # a few KB for each language
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles = {r["lang"]: np.frombuffer(r["vector"]) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in sorted(profiles.items()) if v.any()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``: the language whose profile has the largest cosine with the sum of the text's
    n-gram vectors, and that cosine, at least 0. Ties go to the smaller name. A text that is null or has no letter, or any text
    where nothing was learned, is ``und`` with score 0. Columns of those names are replaced."""
    small_batches(docs.sparkSession)
    names, matrix = list(profiles), np.array(list(profiles.values()), np.float32).reshape(len(profiles), DIMENSION).T
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    shape = docs.limit(0).select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for _, part in _parts(batch.column(at).to_pylist()):
                doc, gram, n, grams, alphabet = gram_counts(part)
                if not len(n) or not names:
                    best += [UNKNOWN] * len(part)
                    score += [0.0] * len(part)
                    continue
                vectors = bundles(doc, gram, n, len(part), grams, alphabet)
                length = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ matrix) / np.maximum(length, 1e-9)[:, None]
                top, has = cosines.argmax(axis=1), np.bincount(doc, minlength=len(part)) > 0
                del doc, gram, n, grams, vectors
                best += [names[i] if h else UNKNOWN for i, h in zip(top.tolist(), has)]
                score += [min(1.0, max(0.0, float(c))) if h else 0.0 for c, h in zip(cosines.max(axis=1), has)]
            give_back()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=shape.names)
    return docs.mapInArrow(run, shape)
