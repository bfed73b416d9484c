"""Byte-level BPE by forced boundaries: text is cut where no vocabulary token can reach across, the pieces are encoded alone."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from tableglass.llm.common import small_batches

#: Fixed value: how byte-level tokenizers of this kind split a text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ({"s", "t", "m", "d"}, {"re", "ve", "ll"})
OTHER, LETTER, NUMBER, WHITE = range(4)
CACHE = 300_000  # words kept by a worker, and pieces of them; then it starts anew
LONG = 1 << 20  # code points from which a text is handled in portions
SAFE = re.compile(r"[A-Za-z0-9] [A-Za-z0-9]")


NONE = 1 << 60  # of a pair that isn't merged; else its rank and, in the low 20 bits, the new id


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or WHITE for each code point. Letters and numbers that the regex module knows from a later Unicode
    version than the tokenizers library, which takes them for neither, are OTHER."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, found = "".join(map(chr, points)), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found[[ord(c) for c in regex.findall(pattern, every)]] = kind
    known = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for kind, before in ((LETTER, "a"), (NUMBER, "1")):
        for c in np.flatnonzero(found == kind).tolist():
            if unicodedata.category(chr(c)) == "Cn" and len(known(before + chr(c))) > 1:
                found[c] = OTHER
    return found


def portions(text: str) -> Iterator[str]:
    """Long texts in portions that end before a plain space between two letters or digits of ASCII, where a word always ends."""
    at = 0
    while len(text) - at > LONG:
        cut = SAFE.search(text, at + LONG)
        if not cut:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


class Codec:
    """Vocabulary, merges and the table of byte pairs that occur inside a token, from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        model = file["model"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.merges = {(self.ids[as_bytes(a)], self.ids[as_bytes(b)]): rank << 20 | self.ids[as_bytes(a + b)] for rank, (a, b) in enumerate(pairs)}
        self.byte_ids = [self.ids[bytes((b,))] for b in range(256)]
        self.special = special
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.kinds = kinds()
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        self.inside = inside
        self.pair_bytes = [[bool(x) for x in row] for row in inside]
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def cuts(self, data: bytes) -> list[int]:
        """Positions between two bytes that are neighbours in no token: no merge ever crosses them."""
        if len(data) > 64:
            b = np.frombuffer(data, np.uint8)
            return (np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist()
        inside = self.pair_bytes
        return [i for i in range(1, len(data)) if not inside[data[i - 1]][data[i]]]

    def piece(self, data: bytes) -> list[int]:
        """The ids of a piece: the merge of the lowest rank, leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) <= 100:
            get = self.merges.get
            ranks = [get(pair, NONE) for pair in zip(ids, ids[1:])]  # of each pair of neighbours
            while ranks and (best := min(ranks)) != NONE:
                at = ranks.index(best)
                new = best & 0xFFFFF
                ids[at:at + 2] = (new,)
                del ranks[at]
                if at:
                    ranks[at - 1] = get((ids[at - 1], new), NONE)
                if at < len(ranks):
                    ranks[at] = get((new, ids[at + 1]), NONE)
            return ids
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m, i, ids[i], ids[j]))
        for i in range(n - 1):
            push(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        data = word.encode()
        if data in self.ids and len(data) <= 2:
            out = self.ids[data].to_bytes(4, "little")
        else:
            cuts = [0, *self.cuts(data), len(data)]
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                part = data[a:b]
                ids = self.pieces.get(part)
                if ids is None:
                    ids = pack(self.piece(part))
                    if len(part) < 64:
                        if len(self.pieces) >= CACHE // 10:
                            self.pieces.clear()
                        self.pieces[part] = ids
                parts.append(ids)
            out = b"".join(parts)
        if len(word) < 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """The words between which nothing is merged, as PATTERN finds them, from the kinds of all characters at once."""
        if not text:
            return []
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kinds[points]
        start = np.empty(len(kind), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        white = kind == WHITE
        # white space before a word: its last character begins anew, and a plain space belongs to the word
        last = np.flatnonzero(white[:-1] & ~white[1:])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        for p in np.flatnonzero(start & (points == 39)).tolist():  # an apostrophe that begins a word
            after = text[p + 1:p + 3]
            n = 1 if after[:1] in ENDINGS[0] else 2 if after in ENDINGS[1] else 0
            if n and after:
                start[p + 1] = False
                if p + 1 + n < len(text):
                    start[p + 1 + n] = True
                    if n == 2:
                        start[p + 2] = False
        at = np.flatnonzero(start).tolist()
        at.append(len(text))
        return [text[i:j] for i, j in zip(at, at[1:])]

    def _words(self, words: list[str]) -> bytes:
        get, make = self.cache.get, self.word
        return b"".join([get(w) or make(w) for w in words])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; special tokens in the text count as such."""
        out, at = [], 0
        found = [(m.start(), m.end(), m[0]) for m in self.split_special.finditer(text)] if self.split_special else []
        for start, end, special in [*found, (len(text), len(text), None)]:
            segment = text[at:start] if found else text
            for portion in portions(segment):
                out.append(self._words(self.words(portion)))
            if special is not None:
                out.append(self.special[special].to_bytes(4, "little"))
            at = end
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text; bytes that are no UTF-8 become replacement characters."""
        of, numbers, out = self.bytes_of.__getitem__, np.frombuffer(ids, "<u4"), []
        for i in range(0, len(numbers), 1 << 20):
            out.append(b"".join(map(of, numbers[i:i + (1 << 20)].tolist())))
        return b"".join(out).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a file, kept from task to task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


ENCODED = "id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", with_ids: bool = True,
                  with_decoded: bool = True) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded, decoded_sha256): every text encoded with the byte-level BPE of ``path`` and decoded.

    ``ids`` holds little-endian unsigned 32-bit integers; ``with_ids`` and ``with_decoded`` leave them and the decoded text out
    (null). A null text is empty and has no tokens; null ids and repeated rows are encoded like others; other columns are not
    read. An empty table gives an empty result. No shuffle: a worker keeps its words in a cache of bounded size and goes
    through very long texts by portions.
    """
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = []
                for t in part.column(1):
                    ids = c.encode(t.as_py())
                    back = c.decode(ids)
                    out.append((len(ids) // 4, ids if with_ids else None, hashlib.sha256(ids).hexdigest(), back if with_decoded else None,
                                hashlib.sha256(back.encode()).hexdigest()))
                n, ids, sha, back, back_sha = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sha, pa.string()), pa.array(back, pa.string()),
                    pa.array(back_sha, pa.string())], names)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ENCODED).withColumnRenamed("id", id_col)
