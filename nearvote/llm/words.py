"""Words and shingles as 64-bit hashes, in NumPy, for the non-native operators.

``bytes.lower`` and the table of white space are exactly the corpus rule: A-Z
become a-z, and words are runs of bytes other than space and 0x09-0x0D.

All words of a text are hashed at once: with random values per byte and powers
of an odd base, a word is a difference of running sums, scaled back by the
inverse power of its start, so equal words hash alike wherever they stand.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.ones(256, dtype=np.int8)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
#: Texts are hashed in parts of about this many bytes, cut at white space.
PART = 1 << 20

_power = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 2 * len(_power), 1 << 14)
        for table, x in ((grown := np.ones((2, size), dtype=np.uint64))[0], _BASE), (grown[1], pow(_BASE, -1, 1 << 64)):
            table[1:] = np.uint64(x)
            np.cumprod(table, out=table)
        _power, _inverse = grown
    return _power, _inverse


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the lower-cased text."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = text.encode().lower()
    if len(raw) <= PART:
        return _hashes(raw)
    out, at = [], 0
    while at < len(raw):
        to = at + PART
        while to < len(raw) and _WORD[raw[to]]:
            to += 1
        out.append(_hashes(raw[at:to]))
        at = to
    return np.concatenate(out)


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_WORD[b], prepend=0, append=0))
    start, end = edges[0::2], edges[1::2]
    power, inverse = _powers(len(b))
    running = np.empty(len(b) + 1, dtype=np.uint64)
    running[0] = 0
    np.cumsum(_VALUE[b] * power[: len(b)], out=running[1:])
    value = (running[end] - running[start]) * inverse[start]
    return mix(value + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by order; fewer words give no window."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer than k words, the whole."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(windows(words, min(k, len(words))))
