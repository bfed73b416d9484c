"""Collocations: frequent phrases by mergeable Misra-Gries summaries, then exact counts, scores and the best of each language."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableglass.llm.common import give_back, lookup, small_batches, stored
from tableglass.llm.packed import MESSAGES, answer, by_bucket, message, sorted_numbers, squeeze, squeeze_numbers, squeeze_sorted, numbers, unsqueeze
from tableglass.llm.words import mix, spans, word_hashes

UNKNOWN = "und"
APART = np.isin(np.arange(256), [*b" \t.,;:!?", *range(0x0A, 0x0E)])  # bytes between words
ENDS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])  # bytes that end a piece
ENDS_PIECE = [bytes([b]) for b in np.flatnonzero(ENDS).tolist()]
CHUNK_BYTES = 8 << 20
BUCKET_MASS = 4 << 20  # occurrences that a hash partition's summary stands for
SLACK = 4  # times the least capacity that keeps every frequent phrase
HASH_BITS = 12  # of a phrase's hash beyond those that tell all occurrences apart
SALTS = 64

CHUNKS = "chunk bigint, langs array<string>, n array<bigint>, of binary, lengths binary, body binary"


class Summary:
    """A Misra-Gries summary of counted hashes, mergeable: at most ``capacity`` counters, each short of its hash's count by no more
    than ``lost``, and lost * (capacity + 1) <= the mass taken in. So a hash whose count exceeds mass / (capacity + 1) has a counter."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.wait: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.wait.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > self.capacity:
            self.settle()

    def merge(self, other: Summary) -> None:
        other.settle()
        self.lost += other.lost
        self.add(other.keys, other.counts)

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.wait]])
        counts = np.concatenate([self.counts, *[c for _, c in self.wait]])
        self.wait, self.waiting = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:  # the (capacity + 1)-th largest goes from every counter
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            above = self.counts > cut
            self.keys, self.counts, self.lost = self.keys[above], self.counts[above] - cut, self.lost + cut

    def reaching(self, least: int) -> np.ndarray:
        """Sorted hashes whose count may be ``least`` or more: all that have it are there."""
        self.settle()
        return self.keys[self.counts + self.lost >= least]


class Phrases:
    """The words of a chunk's documents, and where phrases of each length begin."""

    def __init__(self, langs: list[str], of: bytes, lengths: bytes, body: bytes):
        self.data = unsqueeze(body)
        self.langs = langs
        self.words, self.starts, self.ends = word_hashes(self.data, APART, lower=True)
        raw = np.frombuffer(self.data, np.uint8)
        sizes = np.frombuffer(lengths, "<i8")
        begins = np.cumsum(sizes + 1) - sizes - 1  # a line break between documents ends a piece, too
        self.lang = np.frombuffer(of, "<i4")[np.searchsorted(begins, self.starts, "right") - 1]
        # the pieces' ends up to each word
        ends = np.flatnonzero(ENDS[raw])
        piece = np.searchsorted(ends, self.starts)
        self.stays = np.r_[piece[1:] == piece[:-1], False]  # the next word is in the same piece
        names = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs] or [0], np.uint64)
        self.seeds = names[self.lang]

    def begins(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, hashes with the language) of the phrases."""
        at = np.arange(len(self.words))
        h = mix(self.words ^ self.seeds)
        for n in range(1, longest + 1):
            yield n, at, h
            more = self.stays[at + n - 1]
            at = at[more]
            h = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + self.words[at + n])


def counted(chunk: Phrases, longest: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the chunk's phrases, without their last ``shift`` bits, and their counts."""
    every = np.concatenate([h for _, _, h in chunk.begins(longest)]) >> np.uint64(shift)
    return np.unique(every, return_counts=True)


def segments(text: bytes) -> Iterator[bytes]:
    """A text in parts of up to CHUNK_BYTES, cut where a piece ends; a longer piece stays whole."""
    a = 0
    while len(text) - a > CHUNK_BYTES:
        cut = max(text.rfind(x, a, a + CHUNK_BYTES) for x in ENDS_PIECE)
        if cut < 0:
            cut = min((i for x in ENDS_PIECE if (i := text.find(x, a + CHUNK_BYTES)) >= 0), default=-1)
        if cut < 0:
            break
        yield text[a:cut + 1]
        a = cut + 1
    yield text[a:]


def chunked(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Stored chunks of about 8 MB of text, with the texts' languages and how many words each of these has."""
    small_batches(docs.sparkSession)

    def chunk(number: int, of: list[int], names: list[str], texts: list[bytes]) -> pa.RecordBatch:
        lengths, body = np.array([len(t) for t in texts], "<i8"), b"\n".join(texts)
        begins = np.cumsum(lengths + 1) - lengths - 1
        starts, _ = spans(np.frombuffer(body, np.uint8), APART)
        n = np.bincount(np.array(of)[np.searchsorted(begins, starts, "right") - 1], minlength=len(names))
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([names], pa.list_(pa.string())), pa.array([n.tolist()], pa.list_(pa.int64())),
            pa.array([np.array(of, "<i4").tobytes()]), pa.array([lengths.tobytes()]), pa.array([squeeze(body, 3)])],
            ["chunk", "langs", "n", "of", "lengths", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names, of, texts, size = TaskContext.get().partitionId() << 32, {}, [], [], 0
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1)):
                for part in segments(t.as_py()):
                    of.append(names.setdefault(x, len(names)))
                    texts.append(part)
                    size += len(part) + 16
                    if size >= CHUNK_BYTES:
                        yield chunk(number, of, list(names), texts)
                        number, names, of, texts, size = number + 1, {}, [], [], 0
        if texts:
            yield chunk(number, of, list(names), texts)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, CHUNKS), "texts")


def survivors(chunks: DataFrame, longest: int, least: int, mass: int) -> DataFrame:
    """(chunk, bucket, body): for each chunk's hashes of each partition a bit, 1 where the phrase may occur ``least`` times.

    The first pass. A chunk's hashes and counts go to the hash partitions by their first bits, packed; each partition merges
    them into a summary with a capacity beyond its mass divided by ``least``. Hashes have so many bits that
    few phrases share one; where some do, their counts add up, which lets through more, never less.
    """
    shift = max(0, 64 - HASH_BITS - max(mass, 1).bit_length())
    first_bits = max(0, (mass // BUCKET_MASS).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, counts = counted(Phrases(row["langs"], row["of"], row["lengths"], row["body"]), longest, shift)
                for bucket, at in by_bucket(keys << np.uint64(shift), first_bits):
                    yield message(row["chunk"], bucket, len(p := squeeze_sorted(keys[at])).to_bytes(4, "little") + p + squeeze_numbers(counts[at]))
                del keys, counts
                give_back()

    def reply(_: np.ndarray, bodies: list[bytes]) -> list[bytes]:
        def keys_of(b: bytes) -> np.ndarray:
            return sorted_numbers(b[4:4 + int.from_bytes(b[:4], "little")], "<u8")

        def counts_of(b: bytes) -> np.ndarray:
            return numbers(b[4 + int.from_bytes(b[:4], "little"):], "<i8")
        own = sum(int(counts_of(b).sum()) for b in bodies)
        summary = Summary(SLACK * own // least + 1)
        for b in bodies:
            summary.add(keys_of(b), counts_of(b))
        frequent = np.r_[summary.reaching(least), np.uint64(0xFFFFFFFFFFFFFFFF)]
        del summary
        give_back()
        return [np.packbits(frequent[np.searchsorted(frequent, k)] == k).tobytes() for k in map(keys_of, bodies)]
    return answer(chunks.mapInArrow(ask, MESSAGES), reply)


PACKED = ["lang", "size", "phrase", "f"]
COUNTED = "lang string, size int, phrase string, f bigint"


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _written_out(chunk: Phrases, longest: int, frequent: np.ndarray, shift: int, first_bits: int) -> pa.Table:
    """(bucket, lang, size, phrase, f) of the chunk's phrases whose shortened hash is in ``frequent``, by bucket and phrase."""
    langs, parts = pa.array(chunk.langs, pa.string()), []
    for n, at, h in chunk.begins(longest):
        short = h >> np.uint64(shift)
        some = np.flatnonzero(frequent[np.searchsorted(frequent, short)] == short)
        keys, first, times = np.unique(h[some], return_index=True, return_counts=True)
        first = at[some[first]]
        buckets = (keys >> np.uint64(64 - first_bits)).astype(np.int32) if first_bits else np.zeros(len(keys), np.int32)
        for a in range(0, len(first), 50_000):
            part = first[a:a + 50_000]
            # the words as written in the chunk, lower-cased
            words = [pa.array([chunk.data[x:y].lower() for x, y in zip(chunk.starts[part + k].tolist(), chunk.ends[part + k].tolist())], pa.binary())
                     for k in range(n)]
            parts.append(pa.table([
                pa.array(buckets[a:a + 50_000]), langs.take(pa.array(chunk.lang[part])), pa.array(np.full(len(part), n, np.int32)),
                pc.binary_join_element_wise(*words, b" ").cast(pa.string()), pa.array(times[a:a + 50_000], pa.int64())], names=["bucket", *PACKED]))
    # sorted phrases take less room packed
    return pa.concat_tables(parts).combine_chunks().sort_by([("bucket", "ascending"), ("phrase", "ascending")]) if parts else None


def exact_counts(chunks: DataFrame, bits: DataFrame, longest: int, least: int, mass: int) -> DataFrame:
    """(lang, size, phrase, f) of the phrases with f of ``least`` or more, counted exactly: the second pass. Chunks count their own phrases
    that passed, and send them as text, sorted and packed, to the hash partitions, where they are added up by their text."""
    shift = max(0, 64 - HASH_BITS - max(mass, 1).bit_length())
    first_bits = max(0, (mass // BUCKET_MASS).bit_length())
    mail = bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias("mail"))  # a few small ones from each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                chunk = Phrases(row["langs"], row["of"], row["lengths"], row["body"])
                keys, _ = counted(chunk, longest, shift)
                passed = np.zeros(len(keys), bool)
                mail = {m["bucket"]: m["body"] for m in row["mail"] or ()}
                for bucket, at in by_bucket(keys << np.uint64(shift), first_bits):
                    passed[at] = np.unpackbits(np.frombuffer(mail[bucket], np.uint8), count=at.stop - at.start)
                rows = _written_out(chunk, longest, np.r_[keys[passed], np.uint64(0xFFFFFFFFFFFFFFFF)], shift, first_bits)
                del chunk, keys, passed, mail
                if rows is not None and rows.num_rows:
                    bucket = np.asarray(rows.column("bucket"))
                    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
                    for a, z in zip(cuts, [*cuts[1:], len(bucket)]):
                        yield message(row["chunk"], int(bucket[a]), _packed(rows.slice(a, z - a).select(PACKED)))
                del rows
                give_back()

    def add(group: pa.Table) -> pa.Table:
        """A partition's phrases: no more of them than the occurrences that a partition stands for."""
        tables = [pa.ipc.open_stream(b.as_py()).read_all() for b in group.column("body")]
        sums = pa.concat_tables(tables).group_by(PACKED[:3], use_threads=False).aggregate([("f", "sum")]).rename_columns(PACKED)
        found = sums.filter(pc.greater_equal(sums.column("f"), least))
        del tables, sums
        give_back()
        return found
    sent = chunks.join(mail, "chunk", "left").mapInArrow(run, MESSAGES)
    return sent.groupBy("bucket").applyInArrow(add, COUNTED)


def totals(chunks: DataFrame) -> DataFrame:
    """(lang, n): all words of each language; a language without words isn't there."""
    each = chunks.select(F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("n").alias("n"))))
    return each.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")


def piece(c: Column, first: int, words: int) -> Column:
    """So many words of a phrase from the first-th on, counted from 1."""
    return F.array_join(F.slice(F.split(c, " "), first, words), " ")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, first: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by score, then a, both falling, then the phrase in the order
    of its bytes; rank counts from 1.

    Texts (A-Z lower-cased) are split at ``.,;:!?`` and \\x0A-\\x0D into pieces, these at spaces and tabs into words. n counts a
    language's words, f(phrase) all its occurrences inside pieces. Candidates are phrases of 2 to ``longest`` words with a = f of ``least``
    or more. A candidate cut after a word leaves two parts with l and r = their f, and scores floor(1000000 * a * a / (l * r)); the cut with
    the lowest score counts, of equal ones the first. Candidates inside a longer candidate with 100 * f(longer) >= ``share`` * a go. A null
    text has no words, a null language is ``und``. Repeated rows count again. Other columns are not read; an empty table
    gives an empty result. ``least`` is at least 1; products are exact up to 38 digits.
    """
    chunks = chunked(docs, text, lang)
    per_lang = stored(totals(chunks), "totals")
    mass = int(per_lang.agg(F.sum("n")).first()[0] or 0) * longest  # not less than all phrases
    bits = survivors(chunks, longest, least, mass)
    counts = stored(exact_counts(chunks, bits, longest, least, mass), "phrases")
    phrases = counts.filter("size > 1")
    rows = phrases.count()
    # each cut asks for two parts; a part that many phrases have is hot
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "size", "f", cut)
    sides = F.inline(F.array(F.struct(F.lit(True).alias("left"), piece(F.col("phrase"), 1, F.col("k")).alias("part")),
                             F.struct(F.lit(False).alias("left"), piece(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    parts = cuts.select("lang", "phrase", "size", "f", "k", sides)
    asked = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("asked"))
    known = asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part")), ["lang", "part"])
    found = lookup(parts, known, ["lang", "part"], "asked", rows * 2 * (longest - 1)).groupBy("lang", "phrase", "size", "f", "k").agg(
        F.max(F.when(F.col("left"), F.col("of_part"))).alias("l"), F.max(F.when(~F.col("left"), F.col("of_part"))).alias("r"))
    exact = "decimal(19,0)"
    square = F.col("f").cast(exact) * F.col("f").cast(exact) * F.lit(1_000_000).cast("decimal(7,0)")
    scored = found.withColumn("square", square).withColumn("product", F.col("l").cast(exact) * F.col("r").cast(exact)).withColumn(
        "score", F.expr("square div product"))
    lowest = scored.groupBy("lang", "phrase", "size", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # a phrase inside a longer one is inside one of one word more, or that one inside the longer: all lengths are asked
    longer = phrases.filter("size > 2").select("lang", "size", F.col("f").alias("f_longer"), "phrase", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("words"))
    inside = longer.select("lang", "f_longer", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("words") + 1), lambda i: F.array_join(
        F.slice(F.split("phrase", " "), i, F.col("words")), " "))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f_longer").alias("f_longer"))
    free = lowest.join(inside, ["lang", "phrase"], "left").filter(F.col("f_longer").isNull() | (F.col("f_longer") * 100 < F.col("f") * share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shown = free.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")
    return ranked(shown, first, order).join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(rows: DataFrame, first: int, order: list[Column]) -> DataFrame:
    """The first rows of each language with their rank: the first of each of SALTS parts, then the first of these."""
    def best(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    return best(best(salted, ["lang", "salt"]).drop("rank", "salt"), ["lang"])
