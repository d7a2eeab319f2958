"""Elias-Fano coding of non-decreasing numbers, with sampled select.

A number below ``universe`` is cut into ``low_bits`` low bits, kept packed, and a high part, kept in
unary: bit (high + place) is set for the number at that place. ``select`` finds the place-th set bit by
a table that holds the position of every ``SAMPLE``-th one, so a number is read without decoding those
before it. All of it takes about 2 + log2(universe / n) bits for each number.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = "<QQB"
BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray, universe: int) -> bytes:
    """Bytes of a non-decreasing array of numbers in [0, universe)."""
    n = len(values)
    low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    lows = np.zeros((n, low_bits), np.uint8)
    for bit in range(low_bits):
        lows[:, bit] = (values >> np.uint64(bit)) & np.uint64(1)
    places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros((int(places[-1]) + 1 if n else 0) + 8, np.uint8)
    unary[places] = 1
    samples = places[::SAMPLE].astype("<u4")
    low, high = np.packbits(lows.reshape(-1), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes()
    return struct.pack(HEAD, n, len(high), low_bits) + samples.tobytes() + high + low


class EliasFano:
    """Reads what ``encode`` wrote, from ``at`` on; ``end`` is the place behind it."""

    def __init__(self, raw: bytes | memoryview, at: int = 0) -> None:
        self.n, n_high, self.low_bits = struct.unpack_from(HEAD, raw, at)
        at += struct.calcsize(HEAD)
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(raw, "<u4", n_samples, at)
        self.high = np.frombuffer(raw, np.uint8, n_high, at + 4 * n_samples)
        self.low = np.frombuffer(raw, np.uint8, -(-self.n * self.low_bits // 8), at + 4 * n_samples + n_high)
        self.end = at + 4 * n_samples + n_high + len(self.low)

    def _low(self, place: int) -> int:
        begin = place * self.low_bits
        raw = int.from_bytes(self.low[begin // 8:(begin + self.low_bits + 7) // 8].tobytes(), "little")
        return (raw >> (begin % 8)) & ((1 << self.low_bits) - 1)

    def select(self, place: int) -> int:
        """The number at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        position = int(self.samples[place // SAMPLE])
        wanted = place % SAMPLE  # ones to pass, the sampled one not counted
        byte = position // 8
        head = int(self.high[byte]) & (0xFF << (position % 8) & 0xFF)
        while (ones := int(BIT_COUNT[head])) <= wanted:
            wanted -= ones
            byte += 1
            head = int(self.high[byte])
        for _ in range(wanted):
            head &= head - 1
        position = byte * 8 + (head & -head).bit_length() - 1
        return ((position - place) << self.low_bits) | self._low(place)

    def all(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            for bit in range(self.low_bits):
                out |= bits[:, bit].astype(np.int64) << bit
        return out
