"""Hashes of words and windows don't depend on how a text is cut into blocks."""

import numpy as np
import pytest

from tableglass.llm import words as W


@pytest.mark.parametrize("block", [1 << 19, 16])
def test_blocks(monkeypatch, block):
    text = "One  two\tthree one É two three\n one two three four ONE two".encode()
    whole, starts, ends = W.word_hashes(text, lower=True)
    windows = [W.window_hashes(whole, n, lane) for n in (1, 2, 3) for lane in (0, 1)]
    monkeypatch.setattr(W, "BLOCK", block)
    again, s, e = W.word_hashes(text, lower=True)
    assert np.array_equal(whole, again) and np.array_equal(starts, s) and np.array_equal(ends, e)
    monkeypatch.setattr(W, "BLOCK", 4)
    assert all(np.array_equal(x, y) for x, y in zip(windows, [W.window_hashes(whole, n, lane) for n in (1, 2, 3) for lane in (0, 1)]))
    names = [text[a:b].lower() for a, b in zip(starts, ends)]
    assert len(set(whole.tolist())) == len(set(names)) == len({(n, h) for n, h in zip(names, whole.tolist())})
    three = W.window_hashes(whole, 3)
    assert {i for i in range(len(three)) if three[i] == three[0]} == {i for i in range(len(three)) if names[i:i + 3] == names[:3]}


def test_empty():
    assert len(W.word_hashes(b"")[0]) == len(W.word_hashes(b" \n ")[0]) == len(W.window_hashes(np.zeros(2, np.uint64), 3)) == 0
