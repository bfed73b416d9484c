"""Shared lines against brute force, over many small tasks so that keys run across their borders."""

import hashlib
import random
from collections import defaultdict

import pytest

from tableglass.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least, keep_first=False):
    docs, firsts = defaultdict(set), {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        for pos, line in enumerate((text or "").split("\n")):
            key = lower(line.strip(BLANKS))
            docs[key].add(doc)
            firsts.setdefault(key, (doc, pos))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for pos, line in enumerate(lines):
            key = lower(line.strip(BLANKS))
            if not key or len(docs[key]) < least or (keep_first and firsts[key] == (doc, pos)):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_brute_force(spark, parts, keep_first):
    rng = random.Random(3)
    words = ["hot line", " Hot Line\t", "b", "B ", "É", "é", "", " ", "x" * 3] + [f"w{i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(words[:3] if rng.random() < 0.4 else words) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(None, "hot line\nnull id"), (901, None), (902, ""), (903, "\n" * 50), (904, "hot line\n" * 3000), (905, "no-break \nw1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS id", "'y' AS place", "1 AS pos").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = line_dedup.drop_shared_lines(df, 10, keep_first=keep_first).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    a, b = set(map(tuple, found)), set(brute(rows, 10, keep_first))
    assert len(found) == len(rows) and (a - b, b - a) == (set(), set())


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a\nb")] * 12 + [(2, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in line_dedup.drop_shared_lines(df, 2).select("doc_id", "text").collect()} == {(1, "b"), (2, "")}
    assert line_dedup.drop_shared_lines(df.limit(0)).collect() == []
