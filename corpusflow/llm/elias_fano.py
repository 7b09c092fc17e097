"""Elias-Fano code of a non-decreasing sequence: about 2 + log2(largest / count) bits each.

Every value is split: its low bits lie side by side, its high bits are coded in
unary, value i as a one at position ``high + i`` of a bit vector. ``select`` finds
the i-th one from a sample of every ``EVERY``-th and a scan of one short stretch.
"""

from __future__ import annotations

import numpy as np

EVERY = 256


def _pack(bits: np.ndarray) -> np.ndarray:
    """0/1 values, lowest first, as whole 64-bit words."""
    padded = np.zeros((len(bits) + 63) // 64 * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little")


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.sample = n, width, low, high, sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, width, _pack(lows.ravel().astype(np.uint8)), _pack(unary), ones[::EVERY].astype(np.uint64))

    def sections(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.sample.tobytes()]

    @classmethod
    def decode(cls, n: int, width: int, low: bytes, high: bytes, sample: bytes) -> EliasFano:
        return cls(n, width, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(sample, "<u8"))

    def slice(self, first: int, last: int) -> np.ndarray:
        """Values first..last-1, from the sampled one before ``first`` on."""
        if first >= last:
            return np.zeros(0, np.int64)
        block = first // EVERY
        start = int(self.sample[block]) // 8
        nearest = (last - 1) // EVERY + 1
        stop = int(self.sample[nearest]) // 8 + 1 if nearest < len(self.sample) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little")) + 8 * start
        ones = ones[ones >= int(self.sample[block])][first - block * EVERY : last - block * EVERY]
        out = (ones - np.arange(first, last)) << self.width
        if self.width:
            bit = np.arange(first * self.width, last * self.width)
            low = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            out += (low.reshape(-1, self.width).astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return out

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])
