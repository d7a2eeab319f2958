"""Quality rules: plain counts, and the likelihood of hashed n-grams under a trusted target and the raw corpus.

Tokens are runs of letters and digits (all bytes from 0x80 on count as letters) and runs of other signs.
Tokens and pairs of neighbouring tokens are hashed into ``BUCKETS`` counters. ``fit_ratios`` counts them over
all documents (raw) and over those labelled as good (target); both are multinomials with one added to
each counter. A document's score is the mean over its n-grams of ln(p_target / p_raw), and
it is kept when it passes the base rules and its score reaches ``threshold``, by that rule alone, for every
document. Counts travel as one block of counters for each task; the table that comes to the driver and is broadcast
has ``BUCKETS`` numbers whatever the input.

Null or empty text has no words, fails the base rules and has score 0. Copies count as often as they occur. With
no labels, or an empty table, every ratio is 0. Labels repeated for one id make it good if one of them does.
Other columns pass through; those named like the results are replaced.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import IS_SPACE, Block, blocks, hash_spans, hash_words, mix, runs, split_words, windows

BUCKETS = 1 << 16
CHUNK = 1 << 12
THRESHOLD = -0.25
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")

# The pair of a token with itself is one feature, whatever the token.
REPEATED = 1

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")] = True
IS_LETTER[128:] = True
IS_SIGN = ~IS_LETTER & ~IS_SPACE


def by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches between the borders in ``first``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def ngram_buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Counters hit by the n-grams of a block, and their borders between its texts."""
    words, signs = runs(IS_LETTER[block.data], block.offsets), runs(IS_SIGN[block.data], block.offsets)
    starts = np.concatenate([words.starts, signs.starts])
    hashes = np.concatenate([hash_words(block.data, words), hash_words(block.data, signs)])
    order = np.argsort(starts, kind="stable")
    hashes, first = hashes[order], words.first + signs.first
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) else hashes
    pairs[hashes[:-1] == hashes[1:]] = REPEATED
    # Token i and the pair that begins with it lie side by side; the last token of a text has no pair.
    both = np.empty((len(hashes), 2), np.int64)
    both[:, 0] = hashes & np.uint64(BUCKETS - 1)
    both[:-1, 1] = pairs & np.uint64(BUCKETS - 1)
    present = np.ones((len(hashes), 2), bool)
    lasts = first[1:][np.diff(first) > 0] - 1
    present[lasts, 1] = False
    sizes = 2 * np.diff(first) - (np.diff(first) > 0)
    return both[present], np.concatenate([[0], np.cumsum(sizes)])


def repeat_words(block: Block, word_hashes: np.ndarray, first: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in windows found twice or more in it."""
    starts, counts = windows(first, width)
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    hashes = mix(hash_spans(word_hashes, starts, starts + width) + mix(rows + np.uint64(1)))
    ranked = np.sort(hashes)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    edges = np.zeros(len(word_hashes) + 1, np.int64)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
        at = starts[twice[place] == hashes]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + width, -1)
    return by_row(np.cumsum(edges)[:-1] > 0, first)


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def fit_ratios(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """ln(p_target / p_raw) of every counter, from all documents; ``good_ids`` has the column ``id_col``."""
    marks = good_ids.select(F.col(id_col).alias("id")).distinct().withColumn("good", F.lit(True))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # Labels grow with the documents, so they are never broadcast, however few they are today.
    marked = texts.hint("merge").join(marks, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                buckets, borders = ngram_buckets(block)
                raw += np.bincount(buckets, minlength=BUCKETS)
                mine = np.repeat(good[block.low:block.high], np.diff(borders))
                target += np.bincount(buckets[mine], minlength=BUCKETS)
        cuts = [slice(at, at + CHUNK) for at in range(0, BUCKETS, CHUNK)]
        cuts = [c for c in cuts if raw[c].any()]
        yield pa.RecordBatch.from_arrays([pa.array([c.start for c in cuts], pa.int32()), pa.array([raw[c].tobytes() for c in cuts], pa.binary()),
                                          pa.array([target[c].tobytes() for c in cuts], pa.binary())], names=["chunk", "raw", "target"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros(CHUNK, np.int64) for name in ("raw", "target")}
        for batch in tables:
            for name, total in sums.items():
                for value in batch.column(name):
                    total += np.frombuffer(value.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sums["raw"].tobytes()]), pa.array([sums["target"].tobytes()])],
                                         names=["chunk", "raw", "target"])

    counted = marked.mapInArrow(count, "chunk int, raw binary, target binary")
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("chunk").applyInArrow(add, "chunk int, raw binary, target binary").collect():
        at = slice(row["chunk"], row["chunk"] + CHUNK)
        raw[at], target[at] = np.frombuffer(row["raw"], np.int64), np.frombuffer(row["target"], np.int64)
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def judge_quality(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``score`` and ``kept``."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)
    rest = [F.col(c) for c in docs.columns if c not in RESULTS]
    inputs = docs.select(*rest, F.col(text_col).cast("binary").alias("_qr_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: [np.empty(0)] for name in RESULTS}
            for block in blocks(batch.column("_qr_text")):
                words = split_words(block)
                n_words = np.diff(words.first)
                visible = ((block.data & 0xC0) != 0x80) & ~IS_SPACE[block.data]
                buckets, borders = ngram_buckets(block)
                repeated = repeat_words(block, hash_words(block.data, words), words.first)
                failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
                score = by_row(shipped.value[buckets], borders) / np.maximum(np.diff(borders), 1)
                raw = block.data.tobytes()
                cuts = block.offsets.tolist()
                lines = np.array([duplicate_lines(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
                for name, value in zip(RESULTS, (n_words, by_row(visible, block.offsets), by_row(IS_SYMBOL[block.data], block.offsets),
                                                 lines, repeated, failed, score, ~failed & (score >= threshold))):
                    found[name].append(value)
            columns = [pa.array(np.concatenate(found[name])).cast(kinds[name]) for name in RESULTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *RESULTS])

    kinds = {name: pa.bool_() if name in ("base_failed", "kept") else pa.float64() if name == "score" else pa.int64() for name in RESULTS}
    added = {name: F.lit(False) if kinds[name] == pa.bool_() else F.lit(0.0) if name == "score" else F.lit(0).cast("bigint") for name in RESULTS}
    schema = inputs.drop("_qr_text").withColumns(added).schema
    for field in schema.fields:
        field.nullable = True
    return inputs.mapInArrow(judge, schema)
