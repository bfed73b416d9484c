"""Benchmark passages against brute force."""

import hashlib
import random
import re

import pytest

from tableglass.llm import decontaminate as D


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size):
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for a in range(max(1, len(v) - size + 1) if v else 0):
                win = v[a:a + size]
                for b in range(len(w) - len(win) + 1):
                    if w[b:b + len(win)] == win:
                        hit.update(range(b, b + len(win)))
                        names.add(str(item))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(["a", "B", "c1", "é", "É", "the", "x"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([2, 3, 4, 6, 9]))) for i in range(25)] + [(25, None), (26, ""), (27, "..."), (3, "the the the"), (None, "c1 c1 x"), (28, "zzz a b c")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (None, "c1 c1 x"), (5, "A b"), (5, "A b"), (62, "a " * 3000)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_brute_force(spark, data, block_bytes):
    docs, items = data
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS segment").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    index = D.build_index(df, segment_bytes=500)
    found = D.contamination(df, bench, 4, index=index, block_bytes=block_bytes).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, found), key=str) == brute(docs, items, 4)


def test_empty(spark, data):
    docs, items = data
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contamination(df.limit(0), bench).collect() == []
    assert not any(r["contaminated"] for r in D.contamination(df, bench.limit(0)).collect())


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red one two blue three"), (2, "blue red"), (3, "red a b c d e blue"), (4, "red")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "Red blue"), (8, "none red")], "phrase_id bigint, text string")
    found = {(r["doc_id"], r["phrase_id"]) for r in D.proximity(D.build_index(df), asked, 3).collect()}
    assert found == {(1, "7"), (2, "7")}
