"""Language model scores by a probabilistic suffix tree: contexts of varying length, kept where they tell something."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import small_batches, stored
from tableglass.llm.packed import (CHUNK_BYTES, CHUNKS, NO_ID, answer, ask, bits, bucket_bits, by_bucket, delivered, gathered, id_and_text, numbers,
                                   sorted_numbers, squeeze_numbers, squeeze_sorted)
from tableglass.llm.words import mix, word_hashes

START, END = np.uint64(0x53544152), np.uint64(0x454E4400)  # stand for a text's begin and end among the words' hashes
LEAST = 32  # occurrences in training texts from which a context is considered
WEIGHT = 8.0  # of the shorter context's distribution, in occurrences
FOLDS, HELD_OUT = 5, 1


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()], bool)


def _token_chunks(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Chunks whose body is the sequence of tokens as numbers in the chunk's sorted vocabulary of hashes (in ``lengths``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in gathered(batches, CHUNK_BYTES):
            words, starts, _ = word_hashes(b"\n".join(texts), lower=True)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            firsts = np.r_[np.searchsorted(starts, begins), len(words)]
            n = len(ids)
            doc = np.repeat(np.arange(n), np.diff(firsts))
            s = np.empty(len(words) + 2 * n, np.uint64)
            s[firsts[:-1] + 2 * np.arange(n)] = START
            s[firsts[1:] + 2 * np.arange(n) + 1] = END
            s[np.arange(len(words)) + 2 * doc + 1] = words
            vocabulary, codes, counts = np.unique(s, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]),
                pa.array([_join(squeeze_numbers(rank), squeeze_sorted(vocabulary.astype("<u8")))], pa.binary()),
                pa.array([squeeze_numbers(rank[codes])], pa.binary())], [f.split()[0] for f in CHUNKS.split(", ")])
    return stored(id_and_text(docs, id_col, text).mapInArrow(run, CHUNKS), "tokens")


def _join(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _part(b: bytes) -> tuple[bytes, bytes]:
    n = 8 + int.from_bytes(b[:8], "little")
    return b[8:n], b[n:]


class _Tokens:
    """A chunk's tokens with what is known of them from the answers so far. ``mail`` has, by round, the counts of the words, of the
    pairs and triples that were asked for, and which contexts are kept."""

    def __init__(self, ids: bytes, words: bytes, body: bytes, first_bits: int, mail: dict[int, bytes]):
        self.ids, self.first_bits = np.frombuffer(ids, "<i8"), first_bits
        self.mail = [{b - r * ROUND: m for b, m in mail.items() if b // ROUND == r} for r in range(5)]
        ranks, vocabulary = _part(words)
        back = numbers(ranks, "<u4")
        self.vocabulary = sorted_numbers(vocabulary, "<u8")
        code = np.empty(len(back), np.int64)
        code[back] = np.arange(len(back))
        self.s = code[numbers(body, "<u4")]
        begin, end = np.searchsorted(self.vocabulary, [START, END])
        self.begin, self.end = int(begin), int(end)
        self.scored = self.s != self.begin
        starts = np.flatnonzero(~self.scored)
        self.lengths = np.diff(starts, append=len(self.s)) - 1
        self.held = held_out(self.ids)
        self.train = self.scored & np.repeat(~self.held, self.lengths + 1)
        self.doc_starts = starts

    def counts(self, number: int, hashes: np.ndarray) -> np.ndarray:
        """The counts answered in a round for the sorted hashes."""
        out = np.zeros(len(hashes), np.int64)
        for bucket, at in by_bucket(hashes, self.first_bits):
            out[at] = numbers(self.mail[number][bucket], "<u8")
        return out

    def words(self) -> np.ndarray:
        """Of each word of the vocabulary the number of training occurrences; of START that of texts."""
        self.c = self.counts(0, self.vocabulary)
        self.c[self.begin] = self.c[self.end]
        return self.c

    def pairs(self) -> None:
        """Positions whose context of one word is frequent, and the distinct pairs there."""
        before = np.r_[0, self.s[:-1]]
        self.at2 = np.flatnonzero(self.scored & (self.c[before] >= LEAST))
        self.context1 = before[self.at2]
        self.h2, self.of2 = np.unique(mix(self.vocabulary[self.context1] * np.uint64(0x9FB21C651E98DF25) + self.vocabulary[self.s[self.at2]]), return_inverse=True)

    def triples(self) -> None:
        """Positions whose context of two words is frequent, and the distinct triples there."""
        self.c2 = self.counts(1, self.h2)
        number = np.full(len(self.s), -1, np.int64)  # of the pair that ends at a position
        number[self.at2] = self.of2
        pair = np.r_[-1, number[:-1]]
        pair[~self.scored] = -1
        self.at3 = np.flatnonzero(pair >= 0)
        self.at3 = self.at3[self.c2[pair[self.at3]] >= LEAST]
        self.context2 = pair[self.at3]
        self.h3, self.of3 = np.unique(mix(self.h2[self.context2] * np.uint64(0xC2B2AE3D27D4EB4F) + self.vocabulary[self.s[self.at3]]), return_inverse=True)

    def root(self, total: int, distinct: int) -> None:
        """The probability of each position's token without context."""
        self.p0 = (np.where(self.s == self.begin, 0, self.c[self.s]) + 0.5) / (total + 0.5 * (distinct + 1))

    def one(self) -> None:
        """Probabilities after one word of context, where that is kept."""
        known, kept = np.unique(self.context1), np.zeros(len(self.vocabulary), bool)
        kept[known] = bits(self.mail[2], self.vocabulary[known], self.first_bits)
        self.p1 = self.p0.copy()
        use = kept[self.context1]
        at = self.at2[use]
        self.p1[at] = (self.c2[self.of2[use]] + WEIGHT * self.p0[at]) / (self.c[self.context1[use]] + WEIGHT)
        self.kept1 = kept

    def two(self) -> np.ndarray:
        """Which positions may use two words of context: those that keep the last one."""
        return self.kept1[np.r_[0, self.s[:-1]][self.at3]]


ROUND = 1 << 24  # answers of round r come in buckets from r * ROUND


def _count_messages(hashes: np.ndarray, counts: np.ndarray, first_bits: int, base: int = 0) -> Iterator[tuple[int, bytes]]:
    for bucket, at in by_bucket(hashes, first_bits):
        yield base + bucket, b"c" + _join(squeeze_numbers(counts[at].astype("<u4")), squeeze_sorted(hashes[at].astype("<u8")))


def _gain_messages(hashes: np.ndarray, gains: np.ndarray, first_bits: int, base: int = 0) -> Iterator[tuple[int, bytes]]:
    for bucket, at in by_bucket(hashes, first_bits):
        yield base + bucket, b"g" + _join(gains[at].astype("<f8").tobytes(), squeeze_sorted(hashes[at].astype("<u8")))


def _reply(chunks: np.ndarray, bodies: list[bytes]) -> list[bytes]:
    """To counts the totals, and at the end how many are positive and their sum; to gains a bit: the context's gain over all
    chunks is positive."""
    gain = bodies[0][:1] == b"g"
    parts = [_part(b[1:]) for b in bodies]
    hashes = [sorted_numbers(h, "<u8") for _, h in parts]
    values = [np.frombuffer(v, "<f8") if gain else numbers(v, "<u4").astype(np.float64) for v, _ in parts]
    _, of = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.bincount(of, weights=np.concatenate(values))
    totals = sums[of]
    out, a = [], 0
    for h in hashes:
        part = totals[a:a + len(h)]
        out.append(np.packbits(part > 0).tobytes() if gain else squeeze_numbers(part.astype("<u8")))
        a += len(h)
    return out if gain else [*out, b"%d,%d" % ((sums > 0).sum(), sums.sum())]


def _gains(weights: np.ndarray, contexts: np.ndarray, n: int, own: np.ndarray, context: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Of each of n contexts the sum, over its training occurrences here, of the log of how much better it foretells what
    follows than the shorter context does; the occurrence itself is left out of its counts, else every context would gain."""
    with np.errstate(all="ignore"):  # where nothing was learned from
        better = np.log((own - 1 + WEIGHT * parent) / (context - 1 + WEIGHT) / parent)
    return np.bincount(contexts, weights=np.where(weights, better, 0.0), minlength=n)


SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_context bigint"


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_context), one row for each document.

    The model learns from the documents whose crc32 of the id as text, modulo 5, is not 1. Tokens are the words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end of text. ``base_score`` is the log10 probability by tokens' frequencies
    (add one half), ``score`` that of the suffix tree; ``n_context`` tokens were foretold from a context.

    A context is the one or two tokens before (a text's begin is one). It is a candidate with LEAST training occurrences, and kept
    if the divergence of what follows it from what follows the shorter context is real: the log-likelihood of its followers
    against the shorter context's distribution, each occurrence judged by the others, must gain. A context of two is only
    kept with its last word. Distributions are smoothed towards the shorter context's with WEIGHT occurrences, so they add up
    to one over all known tokens and one unknown. A token is scored in the longest kept context that it follows.

    Null and empty texts are one end; a null id counts as an empty text for the fold; repeated rows teach twice; other columns
    are not read. An empty table gives an empty result. All counts are of the whole corpus: chunks ask for the counts of their
    distinct words, pairs and triples, and a context's gain is the sum of its gains in all chunks.
    """
    small_batches(docs.sparkSession)
    first_bits = bucket_bits(docs, text)
    chunks = _token_chunks(docs, text, id_col)
    total = distinct = 0

    def tokens(row: list, mail: dict[int, bytes]) -> _Tokens:
        return _Tokens(*row[1:4], first_bits, mail)

    def words(t: _Tokens) -> Iterator[tuple[int, bytes]]:
        yield from _count_messages(t.vocabulary, np.bincount(t.s[t.train], minlength=len(t.vocabulary)), first_bits)

    def pairs(t: _Tokens) -> Iterator[tuple[int, bytes]]:
        t.words()
        t.pairs()
        yield from _count_messages(t.h2, np.bincount(t.of2, weights=t.train[t.at2], minlength=len(t.h2)), first_bits, ROUND)

    def single(t: _Tokens) -> Iterator[tuple[int, bytes]]:
        t.words()
        t.pairs()
        t.triples()
        t.root(total, distinct)
        known, of = np.unique(t.context1, return_inverse=True)
        gains = _gains(t.train[t.at2], of, len(known), t.c2[t.of2], t.c[t.context1], t.p0[t.at2])
        yield from _gain_messages(t.vocabulary[known], gains, first_bits, 2 * ROUND)
        yield from _count_messages(t.h3, np.bincount(t.of3, weights=t.train[t.at3], minlength=len(t.h3)), first_bits, 3 * ROUND)

    def double(t: _Tokens) -> Iterator[tuple[int, bytes]]:
        use = after(t)
        known, of = np.unique(t.context2[use], return_inverse=True)
        gains = _gains(t.train[t.at3[use]], of, len(known), t.c3[t.of3[use]], t.c2[t.context2[use]], t.p1[t.at3[use]])
        yield from _gain_messages(t.h2[known], gains, first_bits, 4 * ROUND)

    def after(t: _Tokens) -> np.ndarray:
        t.words()
        t.pairs()
        t.triples()
        t.root(total, distinct)
        t.one()
        t.c3 = t.counts(3, t.h3)
        return np.flatnonzero(t.two())

    def asked(known: DataFrame, question: Callable, name: str) -> DataFrame:
        return stored(answer(ask(known, question, make=tokens), _reply), name)

    first = asked(chunks, words, "words")
    facts = F.split(F.decode("body", "UTF-8"), ",")
    distinct, total = (x or 0 for x in first.filter("chunk = -1").agg(F.sum(facts[0].cast("long")), F.sum(facts[1].cast("long"))).first())
    second = asked(delivered(chunks, first), pairs, "pairs")
    third = asked(delivered(chunks, first, second), single, "contexts")
    fourth = asked(delivered(chunks, first, second, third), double, "contexts2")
    names = [f.split()[0] for f in SCORES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(j)[i].as_py() for j in range(5)]
                t = tokens(row, {m["bucket"]: m["body"] for m in row[4] or ()})
                use = after(t)
                known = np.unique(t.context2[use])
                kept = np.zeros(len(t.h2), bool)
                kept[known] = bits(t.mail[4], t.h2[known], first_bits)
                use = use[kept[t.context2[use]]]
                p, at = t.p1.copy(), t.at3[use]
                p[at] = (t.c3[t.of3[use]] + WEIGHT * t.p1[at]) / (t.c2[t.context2[use]] + WEIGHT)
                log, base = np.where(t.scored, np.log10(p), 0.0), np.where(t.scored, np.log10(t.p0), 0.0)
                context = np.zeros(len(t.s), np.int64)
                context[t.at2[t.kept1[t.context1]]] = 1
                sums = [np.add.reduceat(x, t.doc_starts) for x in (t.scored & (t.c[t.s] > 0), base, log, context)]
                for a in range(0, len(t.ids), 5000):
                    to = slice(a, a + 5000)
                    n = len(t.ids[to])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(t.ids[to], pa.int64(), mask=t.ids[to] == NO_ID), pa.array(t.held[to]), pa.array(t.lengths[to], pa.int64()),
                        pa.array(sums[0][to].astype(np.int64)), pa.array(np.full(n, total), pa.int64()), pa.array(sums[1][to]), pa.array(sums[2][to]),
                        pa.array(sums[3][to])], names)
    return delivered(chunks, first, second, third, fourth).mapInArrow(run, SCORES).withColumnRenamed("id", id_col)
