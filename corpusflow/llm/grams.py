"""Words and runs of words of whole texts as 64-bit numbers, computed on arrays."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time, so a very long text needs no arrays of its own length.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _BASE)]), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)


def _block_words(data: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kept = data[~_BLANK[data]]
    place = np.arange(len(kept)) - np.repeat(first, sizes)
    parts = _BYTE[kept] * _powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(parts, first) + sizes.astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """One number per word of a UTF-8 text; words are cut as ``bytes.split()`` does."""
    if len(data) <= BLOCK:
        return _block_words(np.frombuffer(data, np.uint8))
    out, at, whole = [], 0, np.frombuffer(data, np.uint8)
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and not _BLANK[whole[stop]]:
            stop += 1
        out.append(_block_words(whole[at:stop]))
        at = stop
    return np.concatenate(out)


def runs(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """One number per run of ``n`` words, in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    code = np.full(len(words) - n + 1, np.uint64(seed + n), np.uint64)
    for k in range(n):
        code *= _BASE
        code += words[k : len(words) - n + 1 + k]
    return mix(code)


def shingles(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct runs of ``n`` words; the whole sequence as one when it is shorter."""
    words = word_hashes(data)
    if not len(words):
        return words
    return np.unique(runs(words, min(n, len(words))))
