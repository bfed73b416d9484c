"""Repeated rows of wide tables: same rows as plain grouping, and unique rows that are not shuffled."""

import pytest

from tableglass.operators import clean, quality
from tableglass.plans import repeats


@pytest.fixture
def odd(spark):
    """Copies, NULL against NaN and empty text, 0.0 against -0.0, values that change places, maps."""
    rows = [(1, "a", None, 0.0, {"x": 1, "y": 2}), (1, "a", None, -0.0, {"y": 2, "x": 1}), (2, None, "b", 1.0, {}), (2, "b", None, 1.0, {}),
            (3, "", None, float("nan"), None), (3, "", None, None, None), (3, None, "", None, None), (4, "t" * 50, "u", 2.0, None)]
    rows += [(i, str(i), "z", i * 1.0, {"k": i}) for i in range(10, 60)] + [(11, "11", "z", 11.0, {"k": 11})] * 3
    return spark.createDataFrame(rows, "i int, s string, t string, d double, m map<string,int>").repartition(4)


def plain(rows):
    return sorted(str([sorted(x.items()) if isinstance(x, dict) else x + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("wide,most", [(0, 1_000_000), (0, 0), (10_000, 0)])
@pytest.mark.parametrize("maps", [True, False])
def test_same_rows_whichever_way(odd, monkeypatch, wide, most, maps):
    monkeypatch.setattr(repeats, "WIDE_BYTES", wide)
    monkeypatch.setattr(repeats, "MOST_REPEATED", most)
    df = odd if maps else odd.drop("m")
    assert quality.duplicate_count(df).first()[:2] == (61, 5)
    kept = clean.remove_duplicates(df).collect()
    assert len(kept) == 56 and len(set(plain(kept))) == 56
    if not maps:
        assert [r["i"] for r in quality.duplicate_rows(df, 20).collect()] == [1, 1, 3, 3, 11, 11, 11, 11]
    assert clean.remove_duplicates(df.limit(0)).collect() == [] and quality.duplicate_count(df.limit(0)).first()[0] == 0


def test_unique_rows_are_not_shuffled(spark, monkeypatch, shuffled):
    """What is shuffled are the repeated rows, however many others there are."""
    monkeypatch.setattr(repeats, "WIDE_BYTES", 0)

    def found(n):
        rows = spark.range(0, n, 1, 4).selectExpr("id", "repeat(cast(id as string), 20) AS text", "id * 2 AS x")
        kept = clean.remove_duplicates(rows.unionAll(rows.filter("id < 5")))
        moved = shuffled(lambda: kept.write.format("noop").mode("overwrite").save())
        assert kept.count() == n
        return moved
    few, many = found(2000), found(20_000)
    assert 0 < few < 4000 and many < 1.5 * few
