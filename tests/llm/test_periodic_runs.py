"""Runs of repeated words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tableglass.llm import periodic_runs as R
from tableglass.llm.words import word_hashes


def brute(words, least=12):
    """All runs, from every period's stretches; of equal stretches the one with the least period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            a = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - a + q >= max(least, 2 * q):
                found.setdefault((a - q, i - a + q), q)
            i += i == a
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def random_words(rng):
    letters, n = rng.choice([1, 2, 3, 6, 50]), rng.choice([0, 5, 11, 12, 13, 30, 80, 200])
    if rng.random() < 0.3:
        return [f"w{rng.randrange(letters)}" for _ in range(n)]
    out = []
    while len(out) < n:
        out += [f"w{rng.randrange(letters)}" for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 17, 30]))] * rng.choice([1, 2, 3, 5, 8, 20])
        if rng.random() < 0.5:
            out += out[-rng.randint(1, 60):]
    return out


@pytest.mark.parametrize("least", [12, 13, 20])
def test_brute_force(least, monkeypatch):
    rng = random.Random(least)
    monkeypatch.setattr(R, "BLOCK", 4096)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 8))]
        got = R.runs_of([word_hashes(" ".join(t).encode())[0] for t in texts], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t, least) for t in texts]


def test_work_stays_small_on_the_worst_texts():
    """One word throughout, two such stretches, and a Fibonacci word, whose occurrences in pairs would be billions."""
    a, b = [1], [1, 2]
    while len(b) < 100_000:
        a, b = b, b + a
    same, two, fib = R.runs_of([np.array(x, np.uint64) for x in ([7] * 300_000, [7] * 150_000 + [8] + [7] * 150_000, b)])
    assert same.tolist() == [[0, 300_000, 1]]
    assert two.tolist() == [[0, 150_000, 1], [150_001, 150_000, 1]]
    assert len(fib) > 1000


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(random_words(rng))) for i in range(120)]
    rows += [(None, "é " * 30), (500, None), (501, ""), (502, " \n"), (503, "a b " * 30), (503, "a b " * 30), (504, "x " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "1 AS runs", "2 AS n_words", "text", "'z' AS best").repartition(3)
    found = R.find_runs(df).collect()
    assert len(found) == len(rows) and found[0].__fields__ == ["doc_id", "text", "best", "n_words", "runs", "collapsed"]
    for r in found:
        w = words_of(r["text"])
        runs = brute(w) if len(w) < 1000 else [(0, 200_000, 1)]
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == (collapsed(w, runs) if len(w) < 1000 else "x")
    assert R.find_runs(df.limit(0)).collect() == []


def test_digests_and_planted_runs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(random_words(rng))) for i in range(150)] + [(None, "a b"), (1000, None), (1000, None), (1001, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = R.digests(R.find_runs(R.with_planted_runs(df)))
    want, planted = [], 0
    for i, t in rows:
        w, h = words_of(t), zlib.crc32(str("" if i is None else i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)], planted + 1
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(w, runs))]
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha))
    assert planted > 5
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
