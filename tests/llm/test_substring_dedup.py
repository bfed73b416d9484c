"""Repeated passages against brute force."""

import hashlib
import random
import re

import pytest

from tableglass.llm import packed, substring_dedup


def brute(rows, size):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for i in order:
        w = words[i]
        for a in range(len(w) - size + 1):
            key = tuple(w[a:a + size])
            if key in seen:
                gone[i].update(range(a, a + size))
            seen.add(key)
    return [(d, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest())
            for (d, _), w, g in zip(rows, words, gone)]


@pytest.mark.parametrize("size,start", [(4, None), (4, 1), (8, 2), (3, None)])
def test_brute_force(spark, monkeypatch, size, start):
    rng = random.Random(size)
    phrases = [" ".join(rng.choice("abcdefé") for _ in range(12)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 150):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else f"w{rng.randint(0, 3)}" + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 15))]
        rows.append((i, " ".join(parts)))
    rows += [(None, phrases[0]), (2000, None), (2001, ""), (2002, " "), (2003, "a b " * 400), (2004, "a b " * 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS chunk", "2 AS mail").repartition(3)
    monkeypatch.setattr(packed, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(packed.chunked, "__defaults__", (700,))
    found = substring_dedup.remove_repeats(df, size, start).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows, size), key=str)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "x")], "doc_id bigint, text string")
    assert sorted(tuple(r)[:4] for r in substring_dedup.remove_repeats(df, 4).collect()) == [(1, "", 4, 4), (1, "a b c d", 4, 0), (2, "x", 1, 0)]
    assert substring_dedup.remove_repeats(df.limit(0), 4).collect() == []
    short = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    assert sorted(tuple(r)[:4] for r in substring_dedup.remove_repeats(short, 4).collect()) == [(1, "a", 1, 0), (2, "", 0, 0)]
