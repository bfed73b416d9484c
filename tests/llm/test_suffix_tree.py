"""The suffix tree against a plain one, and that its distributions add up to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tableglass.llm import packed, suffix_tree as S


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]


class Tree:
    def __init__(self, rows):
        self.followers = defaultdict(Counter)
        train = [t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
        self.seen = [["<begin>", *tokens(t)] for t in train]
        for s in self.seen:
            for i in range(1, len(s)):
                for k in (0, 1, 2):
                    if i - k >= 0:
                        self.followers[tuple(s[i - k:i])][s[i]] += 1
        self.n, self.v = sum(self.followers[()].values()), len(self.followers[()])
        self.kept = set()
        for length in (1, 2):
            for c in [c for c in self.followers if len(c) == length and sum(self.followers[c].values()) >= S.LEAST and (length == 1 or c[1:] in self.kept)]:
                f = self.followers[c]
                total, gain = sum(f.values()), 0
                for x, n in f.items():
                    q = self.p(x, c[1:])
                    gain += n * math.log((n - 1 + S.WEIGHT * q) / (total - 1 + S.WEIGHT) / q)
                if gain > 0:
                    self.kept.add(c)

    def p(self, x, context):
        if context not in self.kept:
            return self.p(x, context[1:]) if context else (self.followers[()][x] + 0.5) / (self.n + 0.5 * (self.v + 1))
        f = self.followers[context]
        return (f[x] + S.WEIGHT * self.p(x, context[1:])) / (sum(f.values()) + S.WEIGHT)

    def longest(self, before):
        return next((before[-k:] for k in (2, 1) if len(before) >= k and before[-k:] in self.kept), ())

    def score(self, text):
        s, out, base = ("<begin>", *tokens(text)), 0, 0
        for i in range(1, len(s)):
            out += math.log10(self.p(s[i], self.longest(s[max(0, i - 2):i])))
            base += math.log10(self.p(s[i], ()))
        return base, out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    chain = {w: rng.sample("abcdefghij", 3) for w in "abcdefghij"}
    out = []
    for i in range(400):
        w = ["a"]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(chain[w[-1]] if w[-1] in chain else ["a", "b"]) if rng.random() < 0.7 else rng.choice(["The end", "of It", "rare" + str(rng.randint(0, 500)), "x", "y"]))
        out.append((i, " \n".join(w)))
    return out + [(None, "a b"), (900, None), (901, ""), (902, "   "), (903, "unseen words É"), (904, "a b"), (904, "a b")]


def test_plain_tree(spark, monkeypatch, rows):
    monkeypatch.setattr(packed, "BUCKET_BYTES", 3000)
    tree = Tree(rows)
    assert any(len(c) == 1 for c in tree.kept) and any(len(c) == 2 for c in tree.kept)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS mail").repartition(4)
    found = S.score(df).collect()
    assert len(found) == len(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in found:
        text = texts[r["doc_id"]][0]
        base, score = tree.score(text)
        w = tokens(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(tree.followers[()][x] > 0 for x in w), tree.n)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9), text
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    for c in [(), *list(tree.kept)[:20]]:
        assert sum(tree.p(x, c) for x in [*tree.followers[()], "no such word"]) == pytest.approx(1)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert len(S.score(df).collect()) == 2
    assert S.score(df.limit(0)).collect() == []


def test_counts_beyond_32_bits():
    """Totals of words with billions of occurrences come back whole."""
    from tableglass.llm import suffix_tree as S
    from tableglass.llm.packed import numbers
    hashes = np.array([5, 9], np.uint64)
    bodies = [body for _, body in (m for _ in range(2) for m in S._count_messages(hashes, np.array([3_000_000_000, 1]), 0))]
    answers = S._reply(np.arange(2), bodies)
    assert [numbers(a, "<u8").tolist() for a in answers[:2]] == [[6_000_000_000, 2]] * 2
