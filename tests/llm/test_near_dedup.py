"""Near duplicates against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tableglass.llm import near_dedup


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    s = [sets(t) for _, t in rows]
    n, root = len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(n):
        classes[find(i)].append(i)
    out = [None] * n
    for c in classes.values():
        ids = [rows[i][0] for i in c if rows[i][0] is not None]
        for i in c:
            out[i] = (rows[i][0], min(ids) if ids else None, links[i], len(c))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    out, base = [], [[rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 120, 300]))] for _ in range(12)]
    common = "This line is on very many pages of the site".split()
    for i in range(260):
        w = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(common + w if rng.random() < 0.5 else w)))
    return out + [(300, None), (301, ""), (302, " \n"), (None, "one two"), (303, "One  two"), (304, "one two"), (304, "one two"), (305, "x " * 5000)]


@pytest.mark.parametrize("limit", [800, 12])
def test_brute_force(spark, rows, limit):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS rec", "2 AS row", "3 AS n").repartition(3)
    found = near_dedup.near_duplicates(df, limit=limit, recall=0.9999).select("doc_id", "class_id", "n_links", "class_size", "kept").collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == sorted(brute(rows), key=str)
    classes = {(r["class_id"], r["class_size"], r["doc_id"] if r["class_size"] == 1 else 0) for r in found}
    assert sum(r["kept"] for r in found) == len(classes)


def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []
    alone = near_dedup.near_duplicates(df.filter("doc_id = 300 OR doc_id = 5")).collect()
    assert sorted(tuple(r) for r in alone) == [(5, 5, 0, 1, True), (300, 300, 0, 1, True)]


def test_recall_of_pairs_at_the_threshold():
    """At the default number of runs, pairs just above 0.8 (subsets of 804 of 1,000 tokens) meet after three splits as promised."""
    rng, runs, pairs = np.random.default_rng(5), near_dedup.runs_for(0.99), 4000
    missed = 0
    for _ in range(pairs):
        tokens = rng.integers(0, 1 << 64, 1000, np.uint64)
        last = [near_dedup.paths(np.sort(t), 0.8, runs, 3)[2][1] for t in (tokens, tokens[:804])]
        missed += not len(np.intersect1d(*last))
    assert missed <= 0.014 * pairs  # four standard deviations above 0.0079
    assert near_dedup.miss(runs) <= 0.01 < near_dedup.miss(runs - 1) and near_dedup.miss(runs, 1) < 0.00005


def test_many_partitions_and_empty_rows(spark, rows):
    """More partitions than 128, whose numbers once overflowed, and a partition of a great many empty rows."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(131)
    found = near_dedup.near_duplicates(df, recall=0.9999).select("doc_id", "class_id", "n_links", "class_size").collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows), key=str)
    empty = spark.range(0, 1_300_000, 1, 1).selectExpr("id AS doc_id", "CAST(null AS string) AS text")
    some = spark.createDataFrame([(-1, "a b c d e f"), (-2, "a b c d e f")], "doc_id bigint, text string")
    found = near_dedup.near_duplicates(empty.union(some).coalesce(1)).groupBy("class_size", "kept").count().collect()
    assert sorted(map(tuple, found)) == [(1, True, 1_300_000), (2, False, 1), (2, True, 1)]


def test_numbers_of_records():
    seen = {near_dedup.record((p << 32) + c, k) for p in (0, 127, 128, 5_000_000) for c in (0, 1, 1_048_575) for k in (0, 1, 1_048_575)}
    assert len(seen) == 36 and all(0 <= x < 1 << 63 for x in seen)
