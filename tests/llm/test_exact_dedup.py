"""Exact duplicates on hand tables, with filters of ample and of far too few cells."""

from collections import defaultdict

import pytest

from tableglass.llm import common, exact_dedup

ROWS = [(i, f"text {i % 40}") for i in range(120)] + [(200, None), (201, ""), (None, "text 3"), (None, "alone"), (202, "x" * 100_000), (203, "x" * 100_000),
                                                     (204, "Text 3"), (205, "same"), (205, "same"), (206, "é"), (207, "é")]


@pytest.mark.parametrize("max_cells", [1 << 29, 64])
def test_groups(spark, max_cells, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 1)
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "1 AS digest", "2 AS kept", "3 AS maybe")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    found = exact_dedup.decisions(df, max_cells=max_cells).collect()
    assert len(found) == len(ROWS)
    by_sha = defaultdict(list)
    for r in found:
        by_sha[r["text_sha256"]].append(r)
    assert len(by_sha) == len(groups)
    want = sorted((sorted(map(str, g)), str(max((i for i in g if i is not None), default=None)), len(g)) for g in groups.values())
    assert sorted((sorted(str(r["doc_id"]) for r in rs), str(rs[0]["keep_id"]), rs[0]["group_size"]) for rs in by_sha.values()) == want
    for rs in by_sha.values():
        assert [r["doc_id"] for r in rs if r["kept"]] == [rs[0]["keep_id"]]


def test_unique_rows_do_not_shuffle(spark):
    digests = spark.range(2000).selectExpr("sha2(cast(id % 1990 AS string), 256) AS digest")
    cells = 1 << 15
    tested = exact_dedup.maybe_repeated(digests, exact_dedup.repeated_filter(digests, cells), cells)
    maybe = tested.filter("maybe").count()
    assert 20 <= maybe <= 200


def test_empty(spark):
    assert exact_dedup.decisions(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
