"""Elias-Fano coding of a non-decreasing sequence, with select by a directory of one entry per 512 set bits.

A value's low bits are stored as they are, its high part in unary: value i sets bit (high + i). n values up to u take n * (2 +
log2(u / n)) bits, within half a bit of the least possible; select(i) finds the i-th set bit from a sampled position.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<IQB")
SAMPLE = 512


def encode(values: np.ndarray) -> bytes:
    values = values.astype(np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    bits[high] = 1
    lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
    samples = high[::SAMPLE].astype("<u4")
    return HEAD.pack(n, top, low) + struct.pack("<I", len(bits)) + samples.tobytes() + np.packbits(bits, bitorder="little").tobytes() + np.packbits(lows, bitorder="little").tobytes()


class Reader:
    """Select over encoded boundaries."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.top, self.low = HEAD.unpack_from(data, at)
        (size,) = struct.unpack_from("<I", data, at + HEAD.size)
        at += HEAD.size + 4
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        self.high = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
        at += len(self.high)
        self.lows = np.frombuffer(data, np.uint8, (self.n * self.low + 7) // 8, at)
        self.end = at + len(self.lows)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low):
            bit = i * self.low + b
            out |= ((self.lows[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """The i-th value, found from the nearest sampled set bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, left = at >> 3, left + int(np.unpackbits(self.high[at >> 3 : (at >> 3) + 1], bitorder="little")[: at & 7].sum())
        while left >= (ones := int(np.bitwise_count(self.high[byte]))):
            byte, left = byte + 1, left - ones
        position = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left])
        return ((position - i) << self.low) | int(self._low(np.array([i]))[0])

    def range(self, first: int, stop: int) -> np.ndarray:
        """The values first to stop - 1: one select, then the set bits that follow."""
        if first >= stop:
            return np.zeros(0, np.int64)
        at = (self.select(first) >> self.low) + first
        end = ((self.select(stop - 1) >> self.low) + stop - 1) + 1
        bits = np.unpackbits(self.high[at >> 3 : (end + 7) >> 3], bitorder="little")[at & 7 : (at & 7) + end - at]
        i = np.arange(first, stop)
        return ((np.flatnonzero(bits) + at - i) << self.low) | self._low(i)

    def all(self) -> np.ndarray:
        """Every value."""
        return self.range(0, self.n)
