"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters, marks, digits and ``_`` of any script, lower-cased, so case and punctuation do not matter; signs of
scripts that are written without spaces are a word each. Shingles have
``WIDTH`` words (an item of fewer words is one shingle) and weigh as many bytes as their words have.
Every window of a document that has as many words as some item is a candidate; its SimHash is looked up among the
items of that size. A document of fewer words than an item is one window as a whole. ``BLOCKS`` blocks of eight bits are indexed, each under all values within
``RADIUS // BLOCKS`` bits, so by the pigeonhole principle every fingerprint within ``RADIUS`` is found.
A found item leaks if the weighted Jaccard similarity of the shingle multisets is at least ``THRESHOLD``.
In a fingerprint each distinct shingle counts with the square root of the weight of all its copies. So two
texts of similarity s have a cosine of 2s / (1 + s) or more whatever their weights are, 0.889 at the threshold: their fingerprints
differ in 10 of 64 bits on average, and in more than ``RADIUS`` with a chance of about 4e-6 (recall as measured: README).

No window is passed over unless its similarity to every item is surely too low: the share of its weight
in shingles that occur in no item is an upper bound, taken from prefix sums.

Items are met in blocks of at most ``BLOCK_ITEMS`` texts and ``BLOCK_BYTES``, one broadcast each; a larger benchmark
takes more passes. Null texts have no words, and items without words match nothing. Rows of one id, of
documents or items, are each judged by their own text. Empty tables give no leak and keep every document. Other
columns pass through ``drop_leaks`` and do not matter to ``find_leaks``.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, blocks, hash_spans, hash_words, portions, runs, windows
from .quality import IS_LETTER

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 22
BLOCKS = 8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
SIEVE_BITS = 22
ROOT_UNIT = 256  # of the whole numbers that stand for square roots of weights
TILE = 1 << 13  # shingles whose signed bits are held at once

NO_WORD = r"[^\p{L}\p{M}\p{N}_]+"
ALONE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)"


class Item(NamedTuple):
    item_id: object
    size: int  # words
    hashes: np.ndarray  # of the distinct shingles, sorted
    weights: np.ndarray  # of each, times its count
    fingerprint: int


def weigh(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and the weight of all their copies."""
    distinct, place = np.unique(hashes, return_inverse=True)
    return distinct, np.bincount(place, weights, len(distinct))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def folded(column: pa.Array) -> pa.Array:
    """A binary column whose words are runs of ``IS_LETTER``: texts beyond ASCII get spaces where a word ends."""
    beyond = np.zeros(len(column), bool)
    for block in blocks(column):
        beyond[block.low:block.high] = np.diff(np.concatenate([[0], np.cumsum(block.data >= 0x80)])[block.offsets]) > 0
    if not beyond.any():
        return column
    mask = pa.array(beyond)
    texts = column.filter(mask)
    try:
        texts = texts.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        texts = pa.array([None if raw is None else raw.decode(errors="replace") for raw in texts.to_pylist()], pa.string())
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), NO_WORD, " ")
    return pc.replace_with_mask(column, mask, pc.replace_substring_regex(spaced, ALONE, r" \1 ").cast(pa.binary()))


def roots(weights: np.ndarray) -> np.ndarray:
    return np.rint(np.sqrt(weights) * ROOT_UNIT).astype(np.int64)


def signed(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The root of the weight of each shingle with the sign of each of its 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return (2 * bits - 1) * roots(weights)[:, None]


def window_fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of windows of ``length`` shingles, for ascending starts: prefix sums, but for windows in which a shingle repeats."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    earlier = np.full(len(hashes), -1)
    earlier[order[1:][same]] = order[:-1][same]
    repeats = np.maximum.accumulate(earlier)[starts + length - 1] >= starts
    out = np.empty(len(starts), np.uint64)
    plain = np.flatnonzero(~repeats)
    while len(plain):
        low = starts[plain[0]]
        tile = plain[:max(1, np.searchsorted(starts[plain], low + TILE))]
        high = starts[tile[-1]] + length
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signed(hashes[low:high], weights[low:high]), axis=0)])
        out[tile] = fingerprints(sums[starts[tile] + length - low] - sums[starts[tile] - low])
        plain = plain[len(tile):]
    for place in np.flatnonzero(repeats).tolist():
        at = slice(starts[place], starts[place] + length)
        out[place] = fingerprints(signed(*weigh(hashes[at], weights[at])).sum(axis=0)[None])[0]
    return out


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


NEAR = [[value for value in range(256) if (value ^ other).bit_count() <= RADIUS // BLOCKS] for other in range(256)]


class SizeIndex:
    """The items of one size, by block of their fingerprint."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.fingerprints = np.array([i.fingerprint for i in items], np.uint64)
        self.least_weight = min(i.weights.sum() for i in items)
        self.tables = []
        for block in range(BLOCKS):
            values = (self.fingerprints >> np.uint64(8 * block)) & np.uint64(255)
            table: list[list[int]] = [[] for _ in range(256)]
            for place, value in enumerate(values.tolist()):
                for near in NEAR[value]:
                    table[near].append(place)
            self.tables.append([np.array(places, np.int64) for places in table])

    def within(self, fingerprint: int) -> np.ndarray:
        """Places of all items within the radius."""
        found = np.unique(np.concatenate([table[(fingerprint >> (8 * block)) & 255] for block, table in enumerate(self.tables)]))
        return found[np.bitwise_count(self.fingerprints[found] ^ np.uint64(fingerprint)) <= RADIUS]


class WidthIndex:
    """The items whose shingles have one width: all their shingles, and their indexes by size."""

    def __init__(self, items: list[Item]) -> None:
        by_size: dict[int, list[Item]] = {}
        for item in items:
            by_size.setdefault(item.size, []).append(item)
        self.sizes = {size: SizeIndex(of_size) for size, of_size in sorted(by_size.items())}
        self.shingles = np.unique(np.concatenate([i.hashes for i in items]))
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.shingles >> np.uint64(64 - SIEVE_BITS)] = True

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which shingles occur in some item."""
        out = self.sieve[hashes >> np.uint64(64 - SIEVE_BITS)]
        maybe = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.shingles, hashes[maybe]), len(self.shingles) - 1)
        out[maybe] = self.shingles[place] == hashes[maybe]
        return out


class Shingled(NamedTuple):
    """Shingles of the texts of a block: hashes, weights and their borders between texts."""

    hashes: np.ndarray
    weights: np.ndarray
    borders: np.ndarray


class Texts:
    """The words of a block of texts, shingled at any width."""

    def __init__(self, block) -> None:
        data = LOWER[block.data]
        self.words = runs(IS_LETTER[data], block.offsets)
        self.hashes = hash_words(data, self.words)
        self.bytes = np.concatenate([[0], np.cumsum(self.words.ends - self.words.starts)])

    def shingled(self, width: int) -> Shingled:
        starts, counts = windows(self.words.first, width)
        return Shingled(hash_spans(self.hashes, starts, starts + width), self.bytes[starts + width] - self.bytes[starts],
                        np.concatenate([[0], np.cumsum(counts)]))


def build_index(rows: list[tuple[object, str | None]]) -> dict[int, WidthIndex]:
    """Indexes by shingle width of items (id, text)."""
    items: dict[int, list[Item]] = {}
    for block in blocks(folded(pa.array([(text or "").encode() for _, text in rows], pa.binary()))):
        texts = Texts(block)
        sizes = np.diff(texts.words.first).tolist()
        for width in {min(WIDTH, n) for n in sizes if n}:
            found = texts.shingled(width)
            for row, size in enumerate(sizes):
                if size and min(WIDTH, size) == width:
                    at = slice(found.borders[row], found.borders[row + 1])
                    weighed = weigh(found.hashes[at], found.weights[at])
                    bits = fingerprints(signed(*weighed).sum(axis=0)[None])
                    items.setdefault(width, []).append(Item(rows[block.low + row][0], size, *weighed, int(bits[0])))
    return {width: WidthIndex(of_width) for width, of_width in items.items()}


def search(hashes: np.ndarray, weights: np.ndarray, known: np.ndarray, width: int, index: WidthIndex) -> list[tuple[object, float, int, int]]:
    """(item id, similarity, first word, words) of the best window for each leaking item of one document."""
    total = np.concatenate([[0], np.cumsum(weights)])
    hit = np.concatenate([[0], np.cumsum(np.where(known, weights, 0))])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for size, items in index.sizes.items():
        length = min(size - width + 1, len(hashes))
        if length < size - width + 1 and hit[-1] / items.least_weight < THRESHOLD:
            continue
        bound = (hit[length:] - hit[:-length]) / np.maximum(total[length:] - total[:-length], 1)
        starts = np.flatnonzero(bound >= THRESHOLD)
        if not len(starts):
            continue
        found_at = window_fingerprints(hashes, weights, starts, length)
        order = np.argsort(-bound[starts], kind="stable")
        for start, fingerprint in zip(starts[order].tolist(), found_at[order].tolist()):
            window = None
            for place in items.within(fingerprint).tolist():
                if bound[start] <= best.get((size, place), (0.0, 0))[0]:
                    continue
                window = window or weigh(hashes[start:start + length], weights[start:start + length])
                item = items.items[place]
                found = similarity(window, (item.hashes, item.weights))
                if found >= THRESHOLD and found > best.get((size, place), (0.0, 0))[0]:
                    best[size, place] = (found, start)
    n_words = len(hashes) + width - 1
    return [(index.sizes[size].items[place].item_id, found, start, min(size, n_words)) for (size, place), (found, start) in sorted(best.items())]


def leaks_of(column: pa.Array, indexes: dict[int, WidthIndex]) -> Iterator[tuple[int, list[tuple[object, float, int, int]]]]:
    """(row, leaks) of the rows of a binary column that leak."""
    for block in blocks(folded(column)):
        texts = Texts(block)
        found: dict[int, list] = {}
        for width, index in indexes.items():
            shingled = texts.shingled(width)
            known = index.known(shingled.hashes)
            rows = np.unique(np.searchsorted(shingled.borders, np.flatnonzero(known), "right") - 1)
            for row in rows.tolist():
                at = slice(shingled.borders[row], shingled.borders[row + 1])
                if leaks := search(shingled.hashes[at], shingled.weights[at], known[at], width, index):
                    found.setdefault(block.low + row, []).extend(leaks)
        yield from sorted(found.items())


def without_leaks(batches: Iterator[pa.RecordBatch], text_col: str, indexes: dict[int, WidthIndex]) -> Iterator[pa.RecordBatch]:
    """The rows that do not leak, in portions: no batch is searched or copied as a whole."""
    for part in (p for batch in batches for p in portions(batch, text_col)):
        kept = np.ones(len(part), bool)
        kept[[row for row, _ in leaks_of(part.column(text_col).cast(pa.binary()), indexes)]] = False
        yield part.filter(pa.array(kept))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items, a bounded number at a time."""
    rows: list[tuple[object, str | None]] = []
    size = 0
    for row in items.select(id_col, text_col).toLocalIterator():
        if rows and (len(rows) >= BLOCK_ITEMS or size + len(row[1] or "") > BLOCK_BYTES):
            yield rows
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += len(row[1] or "")
    if rows:
        yield rows


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """(id, item id, ``similarity``, ``first_word``, ``n_words``) for each leak: the item's best window."""
    inputs = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_dc_text"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, similarity double, first_word bigint, n_words bigint"

    def passed(rows: list[tuple[object, str | None]]) -> DataFrame:
        shipped = docs.sparkSession.sparkContext.broadcast(rows)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = build_index(shipped.value)
            for part in (p for batch in batches for p in portions(batch, "_dc_text")):
                leaks = [(row, *leak) for row, of_row in leaks_of(part.column("_dc_text"), indexes) for leak in of_row]
                ids = part.column(id_col).take(pa.array([k[0] for k in leaks], pa.int64()))
                item_ids = pa.array([k[1] for k in leaks], pa.int64() if item_type == "bigint" else None)
                yield pa.RecordBatch.from_arrays(
                    [ids, item_ids, pa.array([k[2] for k in leaks], pa.float64()), pa.array([k[3] for k in leaks], pa.int64()),
                     pa.array([k[4] for k in leaks], pa.int64())], names=[id_col, item_col, "similarity", "first_word", "n_words"])

        return inputs.mapInArrow(find, schema)

    found = [passed(rows) for rows in item_blocks(items, item_col, item_text_col)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item leaks; all columns as they were."""
    for rows in item_blocks(items, item_col, item_text_col):
        docs = _without(docs, rows, text_col)
    return docs


def _without(docs: DataFrame, rows: list[tuple[object, str | None]], text_col: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(rows)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return without_leaks(batches, text_col, build_index(shipped.value))

    return docs.mapInArrow(keep, schema)
