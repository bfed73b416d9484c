"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import small_batches
from tableglass.llm.words import NOT_ALNUM, mix, word_hashes

BUCKETS = 1 << 16  # rows of the embedding table
WIDTH = 8  # of an embedding
GRAMS = (3, 4, 5)  # characters of a subword, the marks < and > at the word's ends included
SAMPLE = 2000  # labelled documents of each class that are learned from, at most
EPOCHS, BATCH, RATE = 10, 64, 5.0
FLOOR = 1e-6  # sums of squared gradients start here, so that rare subwords move little
PAD = 10  # words that weigh nothing, averaged in with every text's own
LEAST_DOCS = 3  # sampled documents that a bucket must occur in; others weigh nothing
PART = 4 << 20  # bytes of texts scored at a time; a longer one alone
WORDS = 50_000  # distinct words cut into subwords at a time


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every subword: the word's character n-grams, and the word itself."""
    text = np.frombuffer(("<" + "><".join(w.decode("utf-8", "replace") for w in words) + ">").encode("utf-32-le"), "<u4")
    word = np.cumsum(text == ord("<")) - 1
    buckets, owners = [], []
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[k:m + k]
        inside = word[:m] == word[n - 1:]
        buckets.append(mix(h[inside]) % np.uint64(BUCKETS))
        owners.append(word[:m][inside])
    # the whole word: a sum of its characters' hashes by place
    starts = np.flatnonzero(text == ord("<"))
    place = (np.arange(len(text)) - starts[word]).astype(np.uint64)
    whole = np.add.reduceat(mix(text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place), starts)
    buckets.append(mix(whole) % np.uint64(BUCKETS))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def distinct_words(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, number of each word among them, first byte of each word); A-Z lower-cased."""
    hashes, starts, ends = word_hashes(data, NOT_ALNUM, lower=True)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return [data[a:b].lower() for a, b in zip(starts[first].tolist(), ends[first].tolist())], number, starts


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text: the mean of its words' bags, a bag being the mean of a word's subwords; weights add up to
    a little less than 1, because of PAD."""
    words, number, _ = distinct_words(data)
    total = np.zeros(BUCKETS)
    times = np.bincount(number, minlength=len(words)) / (len(number) + PAD)
    for a in range(0, len(words), WORDS):
        bucket, word = subwords(words[a:a + WORDS])
        share = times[a:a + WORDS] / np.bincount(word)
        total += np.bincount(bucket, share[word], BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets.astype(np.uint16), total[buckets].astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): what embeddings and softmax, learned together by gradients from (label, buckets, weights),
    come to; the log odds of a text are the mean of its subwords' weights plus the bias. Both classes count alike. Empty without
    rows of both."""
    labels = np.array([y for y, _, _ in rows], np.int64)
    counts = np.bincount(labels, minlength=2)
    if not counts[:2].all():
        return np.zeros(BUCKETS), 0.0
    weight = (len(rows) / 2 / counts)[labels].astype(np.float32)
    random = np.random.Generator(np.random.PCG64(seed))
    # what few documents share tells the documents apart, not the classes
    docs_with = np.zeros(BUCKETS, np.int64)
    for _, b, _ in rows:
        docs_with[b] += 1
    known = docs_with >= min(LEAST_DOCS, len(rows) // 2)
    rows = [(y, b[known[b]], w[known[b]]) for y, b, w in rows]
    table = random.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32) * known[:, None]
    softmax = random.normal(0, 1, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full(p.shape, FLOOR, np.float32) for p in (table, softmax, bias)]  # sums of squared gradients
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
            size = np.array([len(rows[i][1]) for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            bucket, share = (np.concatenate([rows[i][k] for i in part]) for k in (1, 2))
            mean = np.stack([np.bincount(doc, share * table[bucket, k], len(part)) for k in range(WIDTH)], 1).astype(np.float32)
            logits = mean @ softmax + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            miss = odds / odds.sum(axis=1, keepdims=True)
            miss[np.arange(len(part)), labels[part]] -= 1
            miss *= weight[part, None] / len(part)
            back = miss @ softmax.T
            rows_of, at = np.unique(bucket, return_inverse=True)
            slope = np.stack([np.bincount(at, share * back[doc, k], len(rows_of)) for k in range(WIDTH)], 1).astype(np.float32)
            for p, g, s, to in ((table, slope, seen[0], rows_of), (softmax, mean.T @ miss, seen[1], slice(None)), (bias, miss.sum(axis=0), seen[2], slice(None))):
                s[to] += g * g
                p[to] -= rate * g / np.sqrt(s[to])
    return (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str, id_col: str, sample: int) -> DataFrame:
    """(id, label, text) of the documents to learn from: of each class those ``sample`` ids with the least hashes."""
    ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label).cast("int").alias("label")).join(ids, "id")
    chosen = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    some = F.broadcast(chosen[0].unionByName(chosen[1]))  # two times ``sample`` ids
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(some, "id")
    return texts.groupBy("id", "label").agg(F.max("text").alias("text"))  # of rows of one id one


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model: a weight for each bucket and a bias.

    ``labels`` has (doc_id, label 0 or 1); other labels and null ids teach nothing, of several labels of an id the larger counts, of
    several texts the greater. At most ``sample`` documents of each class are learned from, whole; only their subwords' buckets
    and shares (no more than ``BUCKETS`` numbers for each) reach the driver. Without documents of both classes the model is all zeros.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]],
                                             ["id", "label", "buckets", "shares"])
    small_batches(docs.sparkSession)
    # subwords' buckets are 16-bit numbers, so a row is 400 KB at most, and some 15 KB for a text of 3 KB
    some = labelled(docs, labels, label, text, id_col, sample).select(F.col("id").cast("string").alias("id"), "label", F.col("text").cast("binary").alias("text"))
    found = some.mapInArrow(run, "id string, label int, buckets binary, shares binary").toArrow().sort_by("id")
    rows = [(y, np.frombuffer(b, np.uint16), np.frombuffer(w, np.float32)) for y, b, w in zip(
        *[found.column(c).to_pylist() for c in ("label", "buckets", "shares")])]
    return train(rows)


def _parts(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in runs of about PART bytes; a longer one alone."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1])
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def log_odds(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Of each text: the mean over its words, and PAD weightless ones, of the means of their subwords' weights, plus the bias."""
    words, number, starts = distinct_words(b"\n".join(texts))
    value = np.zeros(len(words))
    for a in range(0, len(words), WORDS):
        bucket, word = subwords(words[a:a + WORDS])
        value[a:a + WORDS] = np.bincount(word, weights[bucket]) / np.bincount(word)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begins, starts, "right") - 1
    return np.bincount(doc, value[number], len(texts)) / (np.bincount(doc, minlength=len(texts)) + PAD) + bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """The rows with ``score``, the probability of class 1, and ``predicted`` (1 if the score is 0.5 or more, else 0). Columns of those
    names are replaced. A text that is null, empty or without words has the bias's score; a model that learned nothing
    gives 0.0 and 0."""
    weights, bias = model
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shape = docs.limit(0).select("*", F.lit(0.0).alias("score")).schema
    at = docs.columns.index(text)
    empty = not weights.any() and not bias
    light = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [log_odds(part, light, bias) for part in _parts(b.column(at).fill_null("").cast(pa.binary()))]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(odds), -500, 500))) if odds else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros_like(p) if empty else p, pa.float64())], names=shape.names)
    return docs.mapInArrow(run, shape).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
