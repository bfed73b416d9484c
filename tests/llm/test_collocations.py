"""Collocations against brute force; what a Misra-Gries summary promises."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tableglass.llm import collocations as C


def brute(rows, longest=3, least=10, share=50, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {}
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in good.items():
        longer = [x for (y, q), x in good.items() if y == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * x >= share * a for x in longer):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in found.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:first])]


@pytest.fixture
def rows():
    rng = random.Random(4)
    vocabulary = [rng.choice("abcdéZ") + rng.choice(["", "x", "Y", "日"]) for _ in range(14)]
    out = []
    for _ in range(200):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "new York city" for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", " \x0b"]) for w in words)))
    return out + [("en", None), ("en", ""), ("xx", "? !"), ("de", "ja " * 9), ("de", "ja ja ja"), (None, "ja " * 400)]


@pytest.mark.parametrize("longest,least,share,first", [(3, 10, 50, 2000), (4, 3, 80, 7), (2, 1, 50, 2000)])
def test_brute_force(spark, monkeypatch, rows, longest, least, share, first):
    monkeypatch.setattr(C, "CHUNK_BYTES", 700)
    monkeypatch.setattr(C, "BUCKET_MASS", 3000)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS phrase", "3 AS chunk").repartition(3)
    found = C.collocations(df, longest, least, share, first)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in found.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, longest, least, share, first))


def test_edges(spark):
    df = spark.createDataFrame([("a", None), (None, ""), ("b", " . ")], "lang string, text string")
    assert C.collocations(df).collect() == [] and C.collocations(df.limit(0)).collect() == []
    long = [("a", "x y " * 300_000)]
    assert sorted(map(tuple, C.collocations(spark.createDataFrame(long, "lang string, text string")).collect())) == brute(long)


def test_summary_keeps_every_frequent_hash():
    rng = np.random.default_rng(2)
    keys = np.concatenate([rng.zipf(1.2, 30_000), rng.integers(10**6, 10**7, 30_000)]).astype(np.uint64)
    least = 10
    parts = [np.unique(p, return_counts=True) for p in np.array_split(rng.permutation(keys), 40)]
    whole, halves = C.Summary(len(keys) // least + 1), [C.Summary(len(keys) // least + 1) for _ in range(2)]
    for i, (k, c) in enumerate(parts):
        whole.add(k, c)
        halves[i % 2].add(k, c)
    halves[0].merge(halves[1])
    values, counts = np.unique(keys, return_counts=True)
    truth = dict(zip(values.tolist(), counts.tolist()))
    for s in (whole, halves[0]):
        passed = s.reaching(least)
        assert len(s.keys) <= s.capacity and s.lost * (s.capacity + 1) <= len(keys) and s.lost < least
        assert set(values[counts >= least].tolist()) <= set(passed.tolist())
        assert all(c <= truth[k] <= c + s.lost for k, c in zip(s.keys.tolist(), s.counts.tolist()))


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 10)
    for text in (b"", b"short", b"aaaa. bbbb, cccc dddd eeee ffff\ngg", b"no end at all in this one", b"." * 35):
        parts = list(C.segments(text))
        assert b"".join(parts) == text and all(p[-1:] in C.ENDS_PIECE for p in parts[:-1])
