"""Language identification: vectors against a plain computation, held-out accuracy, odd rows."""

import numpy as np

from tableglass.llm import language as L
from tableglass.llm.common import fold, table


def test_vector_of_a_text():
    texts = ["Ab, c", "", "é", "123"]
    doc, gram, n, grams, alphabet = L.gram_counts(texts)
    counts = np.zeros((4, len(grams)))
    counts[doc, gram] = n
    got = counts @ L.gram_vectors(grams, alphabet)
    roll = np.roll
    for i, t in enumerate(["\0ab\0c\0", "", "\0é\0", ""]):
        want = np.zeros(L.DIMENSION)
        for j in range(len(t) - 2):
            if t[j + 1] != "\0":
                a, b, c = (L.letter_vector(ord(x)).astype(float) for x in t[j:j + 3])
                want += roll(a, 2) * roll(b, 1) * c
        assert np.array_equal(got[i], want), t


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    profiles = L.learn(docs.filter(fold() != 0))
    rows = L.predict(docs.filter(fold() == 0), profiles).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    known = spark.createDataFrame([("the cat and the hat", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("x", None), ("12", "it")], "text string, lang string")
    profiles = L.learn(known)
    assert sorted(profiles) == ["de", "en"]
    rows = [(1, "the hat"), (1, "the hat"), (2, None), (3, ""), (4, "123 !"), (None, "und der Hund"), (5, "the " * 400_000), (6, "中文")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "'x' AS score", "'y' AS lang_pred", "text")
    found = [(r["doc_id"], r["lang_pred"]) for r in L.predict(df, profiles).collect()]
    assert sorted(found[:5] + found[5:7], key=str) == sorted([(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (5, "en")], key=str)
    assert L.learn(known.limit(0)) == {}
    assert {r["lang_pred"] for r in L.predict(df, {}).collect()} == {"und"}
    assert L.predict(df.limit(0), profiles).collect() == []


def test_learn_and_predict_as_by_hand(spark):
    """Profiles, cosines, argmax and ties against a plain computation, letter by letter."""
    known = [("the cat and the hat", "en"), ("der Hund und die Katze", "de"), ("the end", "en"), ("der Hund und die Katze", "xx"), ("日本語の文", "ja")]
    texts = ["the hat", "Hund, und", "q", "日本語", "cat Hund"]

    def vector(t):
        letters = "\0" + "".join(c.lower() if c.isalpha() else "\0" for c in t) + "\0"
        while "\0\0" in letters:
            letters = letters.replace("\0\0", "\0")
        out = np.zeros(L.DIMENSION)
        for j in range(len(letters) - 2):
            if letters[j + 1] != "\0":
                a, b, c = (L.letter_vector(ord(x)).astype(float) for x in letters[j:j + 3])
                out += np.roll(a, 2) * np.roll(b, 1) * c
        return out
    sums = {}
    for t, lang in known:
        sums[lang] = sums.get(lang, 0) + vector(t)
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    profiles = L.learn(spark.createDataFrame(known, "text string, lang string").repartition(3))
    assert sorted(profiles) == ["de", "en", "ja", "xx"] and all(np.allclose(profiles[k], unit[k]) for k in unit)
    found = L.predict(spark.createDataFrame([(t,) for t in texts], "text string"), profiles).collect()
    for r in found:
        v = vector(r["text"])
        cosines = {k: float(v @ unit[k] / np.linalg.norm(v)) for k in sorted(unit)}
        best = max(cosines, key=lambda k: round(cosines[k], 5))  # de and xx tie, the smaller name wins
        assert r["lang_pred"] == best and abs(r["score"] - max(0, cosines[best])) < 1e-5


def test_many_letters_in_bounded_memory():
    """Nearly every trigram of such a text is another one; vectors are made for some thousands at a time."""
    import tracemalloc
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 5000, 300_000)))
    L.letters()
    [L.letter_vector(0x4E00 + i) for i in range(5000)]
    doc, gram, n, grams, alphabet = L.gram_counts([text])
    assert len(grams) > 290_000
    tracemalloc.start()
    got = L.bundles(doc, gram, n, 1, grams, alphabet)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    times = np.bincount(gram, n).astype(np.float32)
    want = sum(times[a:a + 9999] @ L.gram_vectors(grams[a:a + 9999], alphabet) for a in range(0, len(grams), 9999))
    assert peak < 100e6 and np.array_equal(got[0], want)
