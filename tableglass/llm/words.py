"""Words of texts as 64-bit hashes in numpy arrays, and hashes of windows of words."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 19  # bytes hashed at a time; also words, for windows
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words that are letters, digits or not ASCII.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number modulo 2^64, and of its inverse; the longest table of a base is kept."""
    if base not in _tables or len(_tables[base][0]) < n:
        bits, out = max(12, (n - 1).bit_length()), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1 << bits, np.uint64)
            for i in range(bits):  # doubling
                p[1 << i:2 << i] = p[:1 << i] * np.uint64(pow(b, 1 << i, 1 << 64))
            out.append(p)
        _tables[base] = (out[0], out[1])
    return _tables[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def spans(data: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last, where ``apart`` marks the 256 byte values between words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~apart[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, apart: np.ndarray = WHITE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a text in UTF-8; A-Z lower-cased if ``lower``. Goes through the text in blocks."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = spans(raw, apart)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    values = VALUES[LOWER] if lower else VALUES
    if len(raw) <= 2 * BLOCK:
        return _hash_block(raw, starts, ends, values), starts, ends
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a = starts[i]
        out.append(_hash_block(raw[a:ends[j - 1]], starts[i:j] - a, ends[i:j] - a, values))
        i = j
    return np.concatenate(out), starts, ends


def _hash_block(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, down = powers(BASE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[:len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash for each window of ``size`` consecutive words; ``lane`` chooses one of two independent hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > BLOCK:
        return np.concatenate([window_hashes(words[a:min(a + BLOCK, n) + size - 1], size, lane) for a in range(0, n, BLOCK)])
    up, down = powers(WINDOW_BASES[lane], len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((mix(words ^ np.uint64(0x5851F42D4C957F2D)) if lane else words) * up[:len(words)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n] + np.uint64(size))
