"""Words of many texts as numpy arrays: splitting, hashing and rolling hashes over whole batches.

A block holds the UTF-8 bytes of some texts one after another. Words are runs of bytes other than space
and \\x09-\\x0D. Hashes are polynomials over 2**64 with random byte values, so the hash of any stretch
is a difference of prefix sums; every hash is mixed before use.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
PORTION_BYTES = 1 << 20
HASH_BYTES = 1 << 18  # whose values are held at once

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
U64 = np.uint64

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
# Odd, and one below a multiple of four, so that powers have a long period and differ early.
BASE = 0x9E3779B97F4A7C17 | 3


class _Powers:
    """BASE**i and its inverse, over 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = self._run(BASE, size)
            self.down = self._run(pow(BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
        return out


POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Block(NamedTuple):
    """Texts of the rows ``low`` to ``high`` of a batch: bytes, and where each text begins."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A binary column cut into blocks of about ``limit`` bytes; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + column.offset + 1)[column.offset:].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield Block(low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


def portions(batch: pa.RecordBatch, name: str, limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into batches of about ``limit`` bytes of one column."""
    for block in blocks(batch.column(name).cast(pa.binary()), limit):
        yield batch.slice(block.low, block.high - block.low)


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, its first word; one more entry at the end


def runs(member: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of True that do not cross from one text to the next."""
    edge = np.zeros(len(member) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], member[:-1]]) if len(member) else member
    after = np.concatenate([member[1:], [False]]) if len(member) else member
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def split_words(block: Block) -> Words:
    return runs(~IS_SPACE[block.data], block.offsets)


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a sequence of 64-bit values."""
    up, down = POWERS.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """Hashes of words as of stretches of their bytes' values, in tiles of ``HASH_BYTES``; a longer word is summed up piece by piece."""
    out = np.empty(len(words.starts), np.uint64)
    low = 0
    while low < len(out):
        begin = words.starts[low]
        high = int(np.searchsorted(words.ends, begin + HASH_BYTES, "right"))
        if high > low:
            values = BYTE_VALUES[data[begin:words.ends[high - 1]]]
            out[low:high] = hash_spans(values, words.starts[low:high] - begin, words.ends[low:high] - begin)
        else:
            high = low + 1
            out[low:high] = mix(np.array([long_sum(data[begin:words.ends[low]])], np.uint64))
        low = high
    return out


def long_sum(data: np.ndarray) -> int:
    """The polynomial of the values of some bytes."""
    up, _ = POWERS.to(HASH_BYTES)
    total = 0
    for at in range(0, len(data), HASH_BYTES):
        values = BYTE_VALUES[data[at:at + HASH_BYTES]]
        total += int((values * up[:len(values)]).sum(dtype=np.uint64)) * pow(BASE, at, 1 << 64)
    return total % (1 << 64)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words within one text, and the number of windows of each text."""
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    ends = np.cumsum(counts)
    starts = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[:-1] - (ends - counts), counts)
    return starts, counts


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
