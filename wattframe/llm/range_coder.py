"""Static range asymmetric numeral system (rANS) over a shared frequency table.

A block of symbols is coded by ``lanes`` interleaved states: symbol i belongs to
lane ``i % lanes``, so one numpy step handles ``lanes`` symbols. States are 64-bit
and kept in [2^31, 2^63); a lane that would overflow hands 32 bits to the block's
word stream. Coding runs backwards and decoding forwards.

Every ``every`` steps the block keeps a checkpoint: the lanes' states, the place in
the word stream and a CRC-32 of the symbols up to the next checkpoint. Segments
between checkpoints decode independently, several of them in one numpy step, and
any range of a block without what comes before it.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<IIIIII")  # symbols, lanes, steps between checkpoints, checkpoints, words, CRC-32 of what follows


class Corrupt(ValueError):
    """A checksum of a block, a segment or a file does not hold."""


@dataclass
class FrequencyTable:
    """Symbols (ascending) and their frequencies, which sum to ``2 ** bits``."""

    symbols: np.ndarray
    freq: np.ndarray
    bits: int

    @classmethod
    def fit(cls, symbols: np.ndarray, counts: np.ndarray, bits: int = 16) -> FrequencyTable:
        """Frequencies in proportion to the counts, at least 1 for every symbol given."""
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols, np.uint32)[order], np.asarray(counts, np.float64)[order]
        while len(symbols) * 4 > 1 << bits:
            bits += 1
        total = 1 << bits
        if not len(symbols):
            return cls(symbols, np.zeros(0, np.uint64), bits)
        freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
        spare = total - int(freq.sum())
        by_size = np.argsort(-freq, kind="stable")
        if spare >= 0:
            freq[by_size[0]] += spare
        else:  # take from the frequent ones what the floor of 1 gave to the rare ones
            for i in by_size:
                take = min(-spare, int(freq[i]) // 2)
                freq[i] -= take
                spare += take
                if not spare:
                    break
        return cls(symbols, freq.astype(np.uint64), bits)

    def __post_init__(self):
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(self.freq) else self.freq
        self._slots = self._places = None

    @property
    def places(self) -> np.ndarray:
        """Symbol -> its place in the table (one of those given at the fit)."""
        if self._places is None:
            self._places = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.int32)
            self._places[self.symbols] = np.arange(len(self.symbols))
        return self._places

    @property
    def slots(self) -> np.ndarray:
        """Slot -> place of its symbol in the table."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> FrequencyTable:
        body, (crc,) = data[:-4], struct.unpack("<I", data[-4:])
        if zlib.crc32(body) != crc:
            raise Corrupt("frequency table")
        bits, n = struct.unpack_from("<II", body)
        return cls(np.frombuffer(body, "<u4", n, 8).astype(np.uint32), np.frombuffer(body, "<u4", n, 8 + 4 * n).astype(np.uint64), bits)


def lanes_for(n: int, most: int) -> int:
    """Few lanes for a short block, whose states would outweigh its words."""
    lanes = 1
    while lanes < most and lanes * 256 <= n:
        lanes *= 2
    return lanes


def encode_block(ids: np.ndarray, table: FrequencyTable, most_lanes: int = 2048, every: int = 256) -> bytes:
    """A block of at least one symbol; each must be in the table."""
    n, lanes = len(ids), lanes_for(len(ids), most_lanes)
    place = table.places[ids]
    f, c = table.freq[place], table.cum[place]
    limit = f << np.uint64(63 - table.bits)
    bits = np.uint64(table.bits)
    steps = -(-n // lanes)
    states = np.full(lanes, LOW, np.uint64)
    words, points = [], []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min((t + 1) * lanes, n)
        x = states[: b - a]
        full = x >= limit[a:b]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> WORD, x)
        q = x // f[a:b]
        states[: b - a] = (q << bits) + (x - q * f[a:b]) + c[a:b]
        if t % every == 0:
            points.append((len(words), states.copy(), zlib.crc32(ids[a : min((t + every) * lanes, n)].astype("<u4"))))
    sizes = np.cumsum([len(w) for w in words])
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    body = b"".join(struct.pack("<II", int(sizes[-1] - sizes[k - 1]), crc) + s.astype("<u8").tobytes()
                    for k, s, crc in reversed(points)) + stream.astype("<u4").tobytes()
    return HEAD.pack(n, lanes, every, len(points), len(stream), zlib.crc32(body)) + body


def decode_block(data: bytes, table: FrequencyTable, start: int = 0, end: int | None = None) -> np.ndarray:
    """Symbols [start, end) of a block. Only the segments they lie in are decoded."""
    n, lanes, every, n_points, n_words, crc = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    size = 8 + 8 * lanes
    if len(body) != n_points * size + 4 * n_words or zlib.crc32(body) != crc:
        raise Corrupt("block")
    end = n if end is None else min(end, n)
    if start >= end:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(body, "<u4", n_words, n_points * size).astype(np.uint64)
    words = np.concatenate([words, np.zeros(1, np.uint64)])
    segment = lanes * every
    first, last = start // segment, (end - 1) // segment
    at, checks, states = [], [], []
    for k in range(first, last + 1):
        pos, check = struct.unpack_from("<II", body, k * size)
        at.append(pos)
        checks.append(check)
        states.append(np.frombuffer(body, "<u8", lanes, k * size + 8))
    whole = (last - first + 1) if (last + 1) * segment <= n else last - first
    parts = []
    for lo, hi, length in ((0, whole, segment), (whole, last - first + 1, n - last * segment)):
        if lo < hi:
            parts += _decode(np.array(states[lo:hi], np.uint64), np.array(at[lo:hi], np.int64), words, table, length)
    for k, (part, check) in enumerate(zip(parts, checks)):
        if zlib.crc32(part.astype("<u4")) != check:
            raise Corrupt(f"segment {first + k}")
    out = np.concatenate(parts)
    return out[start - first * segment : end - first * segment]


def _decode(x: np.ndarray, at: np.ndarray, words: np.ndarray, table: FrequencyTable, length: int) -> list[np.ndarray]:
    """``length`` symbols from each row of states ``x`` and its place in the words."""
    rows, lanes = x.shape
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty((rows, length), np.int32)
    for a in range(0, length, lanes):
        m = min(lanes, length - a)
        y = x[:, :m]
        slot = y & mask
        place = table.slots[slot]
        out[:, a : a + m] = place
        y = table.freq[place] * (y >> bits) + slot - table.cum[place]
        short = y < LOW
        read = np.cumsum(short, axis=1)
        got = words[np.where(short, at[:, None] + read - 1, -1)]
        x[:, :m] = np.where(short, (y << WORD) | got, y)
        at = at + read[:, -1]
    return [table.symbols[row] for row in out]
