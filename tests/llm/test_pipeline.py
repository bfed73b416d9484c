"""Every stage of the pipeline against a plain computation on what the stage before has kept."""

from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tableglass.llm import language
from tableglass.llm.common import fold, table
from tests.llm.test_decontaminate import words
from tests.llm.test_near_dedup import sets

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that go into each stage, and what the last one returns."""
    docs = table(spark, FOLDER, "documents")
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34", None, None, None), (None, "Is the of and in that here", "en", "s", 26),
           (9004, "Same the words again and of that for in the end", "en", "s", 3), (9004, "Same the words again and of that for in the end", "en", "s", 3)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs.collect()]
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, FOLDER), "test")
        out.append(docs.collect())
    return out


def test_columns_and_language(spark, steps):
    before, after = steps[0], steps[1]
    profiles = language.learn(spark.createDataFrame(before, table(spark, FOLDER, "documents").schema).filter(fold() != 0))
    judged = language.predict(spark.createDataFrame(before, table(spark, FOLDER, "documents").schema), profiles).collect()
    want = [tuple(r)[:5] for r in judged if r["lang_pred"] != "und" and r["score"] >= P.LEAST_COSINE]
    assert sorted(want, key=str) == sorted(map(tuple, after), key=str)
    assert len(after) >= 200
    assert all(r.__fields__ == COLUMNS for rows in steps[:5] for r in rows[:1])


def test_lines(steps):
    before, after = steps[1], steps[2]
    docs = defaultdict(set)
    for r in before:
        for line in r["text"].split("\n"):
            docs[line.strip(" \t\n\x0b\x0c\r").lower()].add(r["doc_id"])
    want = []
    for r in before:
        kept = [x for x in r["text"].split("\n") if not (k := x.strip(" \t\n\x0b\x0c\r").lower()) or len(docs[k]) < 10]
        text = "\n".join(kept)
        text = text if 2 * len(text) >= len(r["text"]) else r["text"]
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert sorted(want, key=str) == sorted(map(tuple, after), key=str)


def test_near_duplicates(steps):
    before, after = steps[2], steps[3]
    all_sets = [sets(r["text"]) for r in before]
    label = list(range(len(before)))
    for i, a in enumerate(all_sets):
        for j in range(i):
            b = all_sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                label = [label[i] if x == label[j] else x for x in label]
    first = {}
    for r, c in zip(before, label):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if c not in first or key < (first[c]["doc_id"] is None, first[c]["doc_id"] or 0):
            first[c] = r
    assert sorted(map(tuple, first.values()), key=str) == sorted(map(tuple, after), key=str)


def test_decontamination(spark, steps):
    before, after = steps[3], steps[4]
    grams = defaultdict(set)
    for r in table(spark, FOLDER, "benchmark").collect():
        w = words(r["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            grams[len(w[i:i + 10])].add(tuple(w[i:i + 10]))
    clean = []
    for r in before:
        w = words(r["text"])
        if not any(tuple(w[i:i + n]) in g for n, g in grams.items() for i in range(len(w) - n + 1)):
            clean.append(tuple(r))
    assert sorted(clean, key=str) == sorted(map(tuple, after), key=str)


def test_tokens(steps):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = {(r["doc_id"], b"".join(i.to_bytes(4, "little") for i in t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in steps[4]}
    assert want == {(r["doc_id"], bytes(r["ids"])) for r in steps[5]}
    assert len(steps[4]) == len(steps[5])


def test_copies_keep_one_text(spark):
    """Of 12 equal documents and of 12 near copies one survives whole and no fragment does; a site's line goes everywhere else."""
    lines = [" ".join(f"{a}{b}w" for b in range(12)) for a in "abcdefgh"]
    equal, near = "\n".join(lines[:4]), lines[4:]
    rows = [(i, equal, "en", "s", 1) for i in range(12)]
    rows += [(100 + i, "\n".join([*near, f"own line {i}"]), "en", "s", 1) for i in range(12)]
    rows += [(200 + i, f"one{i} two{i} three{i}\nfour{i} five{i}\nthe frame", "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    lines_gone = P.stored(P.shared_lines(spark, docs, FOLDER), "test")
    after = {r["doc_id"]: r["text"] for r in lines_gone.collect()}
    assert all(after[i] == r[1] for i, r in enumerate(rows[:12])) and all(after[100 + i] == r[1] for i, r in enumerate(rows[12:24]))
    assert all(after[200 + i] == rows[24 + i][1].removesuffix("\nthe frame") for i in range(12))
    assert all(r["n_chars"] == len(r["text"]) for r in lines_gone.collect())
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, lines_gone, FOLDER).collect()) == [0, 100, *range(200, 212)]


def test_empty_table_and_clashing_columns(spark):
    """Stages keep columns of any name, and an empty table stays empty."""
    odd = ["lang_pred", "score", "c0", "carried", "place", "bitmap", "id", "rec", "class_id", "contaminated", "a.b"]
    docs = table(spark, FOLDER, "documents").limit(40).selectExpr("*", *[f"doc_id AS `{c}`" for c in odd])
    for some, least in ((docs, 1), (docs.limit(0), 0)):
        for name, stage in P.STAGES[:-1]:
            columns, some = some.columns, P.stored(stage(spark, some, FOLDER), "test")
            assert some.columns == columns, name
            assert all(r["doc_id"] == r[c] for r in some.collect() for c in odd), name
        assert P.stored(P.tokens(spark, some, FOLDER), "test").count() >= least
