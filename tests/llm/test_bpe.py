"""BPE by forced boundaries against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tableglass.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_every_code_point(library):
    codec = bpe.Codec(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    points += list(range(0x3000))
    for a in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}b 1{chr(c)} .{chr(c)}{chr(c)}'s" for c in points[a:a + 500])
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, a


def test_random_texts(library):
    codec = bpe.Codec(PATH)
    rng = random.Random(5)
    bits = ["<|endoftext|>", "  ", " ", "\n", "\t", "'s", "'ll", "é", "ß", "中文", "🙂", "a", "the", "xx", "9", "½", " ", " ", "\x1c", "\x85", "_", ",.", "\x00", "́", "�"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000, " " * 3000, "ab" * 3000, "🙂" * 500]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text
        assert codec.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == text


def test_long_texts_go_by_portions(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 10)
    codec = bpe.Codec(PATH)
    text = "some  words\n\n and 1234 <|endoftext|> more 'll  " * 50
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_table(spark, library):
    rows = [(1, "Hello  world"), (None, "x<|endoftext|>"), (2, None), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 AS id", "'z' AS ids")
    found = bpe.encode_decode(df, PATH).collect()
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        expected.append((doc, len(ids), raw, hashlib.sha256(raw).hexdigest(), text or "", hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(((r[0], r[1], bytes(r[2]), *r[3:]) for r in found), key=str) == sorted(expected, key=str)
    assert bpe.encode_decode(df.limit(0), PATH).collect() == []
