"""Toxicity: features and scores against a plain computation, held-out accuracy, misspellings, odd rows."""

import re
from collections import Counter

import numpy as np

from tableglass.llm import toxicity as X
from tableglass.llm.common import fold, table


def plain_bag(word):
    """The subwords of a word, spelled out."""
    w = f"<{word}>"
    return [w[i:i + n] for n in X.GRAMS for i in range(len(w) - n + 1)] + [word]


def test_subwords_and_features():
    words = ["añb", "x", "longer", "añb"]
    bucket, owner = X.subwords([w.encode() for w in words])
    for i, w in enumerate(words):
        assert (owner == i).sum() == len(plain_bag(w))
    assert sorted(bucket[owner == 0]) == sorted(bucket[owner == 3])
    single = {g: b for g, b in zip(plain_bag("longer")[:-1], bucket[owner == 2])}
    assert len(set(single.values())) == len(single)
    b, share = X.features("Añb x, x longer".encode())
    assert abs(share.sum() - 4 / (4 + X.PAD)) < 1e-6
    weights = np.random.default_rng(1).normal(size=X.BUCKETS)
    want = float((weights[b] * share).sum()) + 0.25
    assert np.allclose(X.log_odds(["Añb x, x longer".encode(), b"", b"..."], weights, 0.25), [want, 0.25, 0.25], atol=1e-6)


def test_slices_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 97} tail{i % 13}é" for i in range(3000)).encode()
    weights = np.random.default_rng(1).normal(size=X.BUCKETS)
    whole, f = X.log_odds([text, b"a b"], weights, 0.0), X.features(text)
    monkeypatch.setattr(X, "WORDS", 7)
    assert np.allclose(whole, X.log_odds([text, b"a b"], weights, 0.0))
    assert all(np.allclose(a, b) for a, b in zip(f, X.features(text)))
    assert [len(p) for p in X._parts([type("T", (), {"as_py": lambda s, n=n: b"x" * n})() for n in (3 << 20, 2 << 20, 9 << 20, 1)])] == [2, 1, 1]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = X.learn(docs, labels.filter(fold() != 0))
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter(fold() == 0).collect()}
    rows = X.score(docs.filter(fold() == 0), model).select("doc_id", "score", "predicted").collect()
    got = Counter((truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth)
    assert got[1, 1] / (got[1, 0] + got[1, 1]) > 0.75 and got[0, 1] / (got[0, 0] + got[0, 1]) < 0.06
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == bool(r["predicted"]) for r in rows)


def test_unseen_misspellings(spark):
    rng = np.random.default_rng(3)
    plain = ["table", "window", "garden", "river", "little", "yellow", "paper", "morning", "over", "under", "walks", "reads"]
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, 12))
        if i % 2:
            words[int(rng.integers(12))] = ["dreadful", "dreadfull"][i // 2 % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = X.learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    new = spark.createDataFrame([(1, "the garden dreadfuul river"), (2, "the garden walks river")], "doc_id bigint, text string")
    assert [r["predicted"] for r in X.score(new, model).orderBy("doc_id").collect()] == [1, 0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad words"), (1, "bad words"), (2, "good words"), (3, None), (None, "bad"), (4, ""), (5, "bad " * 400_000)], "doc_id bigint, text string")
    docs = docs.selectExpr("*", "'x' AS score", "'y' AS predicted", "1 AS label", "2 AS id")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (9, 1), (4, None), (2, 7)], "doc_id bigint, toxic int")
    rows = X.labelled(docs, labels, "toxic", "text", "doc_id", 10).collect()
    assert sorted((r["id"], r["label"], r["text"]) for r in rows) == [(1, 1, "bad words"), (2, 0, "good words"), (3, 0, "")]
    assert len(X.labelled(docs, labels, "toxic", "text", "doc_id", 1).collect()) == 2
    model = X.learn(docs, labels)
    found = X.score(docs, model).collect()
    assert len(found) == 7 and found[0]["score"] == found[1]["score"]
    assert {r["score"] for r in found if not r["text"]} == {found[3]["score"]}
    assert found[0].__fields__ == ["doc_id", "text", "label", "id", "score", "predicted"]
    nothing = X.learn(docs, labels.filter("toxic = 0"))
    assert {(r["score"], r["predicted"]) for r in X.score(docs, nothing).collect()} == {(0.0, 0)}
    assert X.score(docs.limit(0), model).collect() == []
    assert not X.learn(docs.limit(0), labels)[0].any()


def test_words_are_those_of_the_pattern():
    text = "Ab-c_d ÉÀ 12x\x00y~z"
    words, number, _ = X.distinct_words(text.encode())
    want = [w.encode().lower().decode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert [words[i].decode() for i in number] == want
