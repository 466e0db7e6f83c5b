"""Elias-Fano sequences in memory-mapped files, with batched access and successor search."""

from __future__ import annotations

import numpy as np

_BLOCK = 4  # 64-bit words per entry of the select directory


def _low_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each, packed into 64-bit words."""
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(width) > 64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


class EliasFano:
    """A non-decreasing sequence below ``universe``: low bits packed, high bits in unary.

    About ``2 + log2(universe / n)`` bits per value. ``arrays`` are its parts, which a caller may
    write to a file and map back.
    """

    def __init__(self, n: int, width: int, arrays: list[np.ndarray]):
        self.n, self.width = n, width
        self.low, self.high, self.zeros = arrays

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(width)).astype(np.int64)
        buckets = (max(universe - 1, 0) >> width) + 1
        bits = np.zeros(-(-(n + buckets + 1) // (64 * _BLOCK)) * 64 * _BLOCK, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        per_block = 64 * _BLOCK - np.bitwise_count(high).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(per_block)])
        low = _low_bits(values & np.uint64((1 << width) - 1), width)
        return cls(n, width, [low, high, zeros])

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number ``k`` (from 0) in the high bits."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        rest = k - self.zeros[block]
        word = block * _BLOCK
        for _ in range(_BLOCK - 1):
            here = 64 - np.bitwise_count(self.high[word]).astype(np.int64)
            step = rest >= here
            rest, word = np.where(step, rest - here, rest), np.where(step, word + 1, word)
        open_, place = ~self.high[word], np.zeros(len(k), np.int64)
        for size in (32, 16, 8, 4, 2, 1):
            inside = (open_ >> place.astype(np.uint64)) & np.uint64((1 << size) - 1)
            here = np.bitwise_count(inside).astype(np.int64)
            step = rest >= here
            rest, place = np.where(step, rest - here, rest), np.where(step, place + size, place)
        return word * 64 + place

    def _begin(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below ``bucket``."""
        before = np.maximum(bucket - 1, 0)
        return np.where(bucket > 0, self._select_zero(before) - before, 0)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | spill) & np.uint64((1 << self.width) - 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value not below each ``x`` (``n`` if none), and whether it equals ``x``.

        The high part names a bucket, a binary search over the bucket's low bits does the rest.
        """
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        first, end = self._begin(bucket), self._begin(bucket + 1)
        low = x & np.uint64((1 << self.width) - 1)
        a, b = first, end
        while (a < b).any():
            middle = (a + b) >> 1
            below = (a < b) & (self._low(np.minimum(middle, self.n - 1)) < low)
            a, b = np.where(below, middle + 1, a), np.where(below, b, middle)
        hit = (a < end) & (self._low(np.minimum(a, self.n - 1)) == low)
        return a, hit
