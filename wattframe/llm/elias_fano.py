"""Elias-Fano sequences in memory-mapped files, queried in whole arrays.

A monotone sequence of n values below u keeps the low l = log2(u / n) bits of each
value packed, and the high parts as a bit map in unary: bit (value >> l) + i is set
for the i-th value. About l + 2 bits a value. Sampled counts of ones and zeros, one
for every 512 bits, make ``get`` and ``successor`` a few array operations.
"""

from __future__ import annotations

import os

import numpy as np

_SPAN = 512
_DENSE = 16  # of as many values or fewer one is asked for: the whole map is read
_U = np.uint64


def save(folder: str, name: str, array: np.ndarray) -> np.ndarray:
    """Write an array and map it into memory."""
    path = os.path.join(folder, name)
    array = np.ascontiguousarray(array)
    if not array.size:
        return array
    array.tofile(path)
    return np.memmap(path, dtype=array.dtype, mode="r", shape=array.shape)


def load(folder: str, name: str, dtype: str) -> np.ndarray:
    """Map an array that ``save`` has written (nothing is written of an empty one)."""
    path = os.path.join(folder, name)
    return np.memmap(path, dtype=dtype, mode="r") if os.path.exists(path) else np.zeros(0, dtype)


class EliasFano:
    @classmethod
    def load(cls, folder: str, name: str) -> EliasFano:
        """A sequence written before."""
        out = cls.__new__(cls)
        out.n, out.l = (int(x) for x in np.fromfile(os.path.join(folder, f"{name}.size"), "<i8"))
        out.low, out.high = load(folder, f"{name}.low", "u1"), load(folder, f"{name}.high", "<u8")
        out.ones, out.zeros = load(folder, f"{name}.ones", "<i8"), load(folder, f"{name}.zeros", "<i8")
        return out

    def __init__(self, folder: str, name: str, values: np.ndarray):
        values = np.asarray(values, dtype=np.uint64)
        self.n = n = len(values)
        last = int(values[-1]) if n else 0
        self.l = l = max(0, min(56, ((last + 1) // max(n, 1)).bit_length() - 1))
        np.array([n, l], "<i8").tofile(os.path.join(folder, f"{name}.size"))
        self.low = save(folder, f"{name}.low", self._packed(values & _U((1 << l) - 1), l))
        bits = np.zeros(-(-(n + (last >> l) + 2) // _SPAN) * _SPAN, np.bool_)
        if n:
            bits[(values >> _U(l)).astype(np.int64) + np.arange(n)] = True
        self.high = save(folder, f"{name}.high", np.packbits(bits, bitorder="little").view("<u8"))
        ones = np.bitwise_count(self.high).reshape(-1, _SPAN // 64).sum(axis=1, dtype=np.int64)
        self.ones = save(folder, f"{name}.ones", np.concatenate([[0], np.cumsum(ones)]))
        self.zeros = save(folder, f"{name}.zeros", np.arange(len(ones) + 1) * _SPAN - np.asarray(self.ones))

    @staticmethod
    def _packed(low: np.ndarray, l: int) -> np.ndarray:
        """Values of l bits each, as bytes, with room to read eight bytes anywhere."""
        if not l or not len(low):
            return np.zeros(8, np.uint8)
        at = np.arange(len(low), dtype=np.int64) * l
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))  # l < 64: every word has a value that starts in it
        words = np.zeros(int(word[-1]) + 3, np.uint64)
        words[: len(starts)] = np.bitwise_or.reduceat(low << shift, starts)
        over = np.flatnonzero(shift + _U(l) > _U(64))
        words[word[over] + 1] |= low[over] >> (_U(64) - shift[over])
        return words.view(np.uint8)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        anywhere = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (anywhere[at >> 3] >> (at & 7).astype(np.uint64)) & _U((1 << self.l) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or unset bit. Many are read off the whole map."""
        if len(k) * _DENSE >= self.n:
            bits = np.unpackbits(self.high.view(np.uint8), bitorder="little").view(np.bool_)
            return np.flatnonzero(bits if ones else ~bits)[k]
        sample = self.ones if ones else self.zeros
        span = np.searchsorted(sample, k, side="right") - 1
        rest = k - sample[span]
        words = self.high.reshape(-1, _SPAN // 64)[span]
        if not ones:
            words = ~words
        counts = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        which = (counts <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        rest -= np.where(which > 0, counts[rows, np.maximum(which - 1, 0)], 0)
        word, bit = words[rows, which], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
            up = rest >= count
            rest -= np.where(up, count, 0)
            bit += np.where(up, width, 0)
            word = np.where(up, word >> _U(width), word)
        return span * _SPAN + which * 64 + bit

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << _U(self.l)) | self._low(i)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the first value >= x within [begin, end), or end."""
        x, begin, end = np.asarray(x, np.uint64), np.asarray(begin, np.int64), np.asarray(end, np.int64)
        if not len(x) or not self.n:
            return end.copy()
        h = (x >> _U(self.l)).astype(np.int64)
        most = len(self.high) * 64 - self.n - 1  # the last unset bit's number
        lo = np.where(h > 0, self._select(np.clip(h - 1, 0, most), False) - (h - 1), 0)
        hi = self._select(np.minimum(h, most), False) - np.minimum(h, most)
        lo, hi = np.where(h > most, self.n, lo), np.where(h > most, self.n, hi)
        lo, hi = np.clip(lo, begin, end), np.clip(hi, begin, end)
        low = x & _U((1 << self.l) - 1)
        go = np.flatnonzero(lo < hi)
        while len(go):
            mid = (lo[go] + hi[go]) >> 1
            less = self._low(mid) < low[go]
            lo[go] = np.where(less, mid + 1, lo[go])
            hi[go] = np.where(less, hi[go], mid)
            go = go[lo[go] < hi[go]]
        return lo
