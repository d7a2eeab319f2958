"""Substring deduplication: rolling hashes of all windows of ``width`` words, counted over the corpus.

Documents are dealt into groups that are contiguous in their id (see ``ranges``), about ``GROUP_BYTES`` of
text each. Every group hashes all its windows by a Rabin-Karp recurrence over 2**64 and sends each
distinct hash once, sorted and cut by its leading bits into buckets. A bucket sees which groups hold a hash;
all but the lowest group get its bit set in their answer. A group then removes what an earlier group
holds, and what an earlier document of its own holds; overlapping windows merge into maximal intervals.
So a passage that a third of all documents share costs one entry for each group, not for each document,
and texts are shuffled once (both uses read the same exchange).

Two different windows share a 64-bit hash with a chance of 2**-64; there is no second look.

Null text has no words. Documents with fewer words than the window lose nothing. Windows are compared
only between different ids: rows of one id never remove each other's words. Rows without id are neither
source nor target. An empty table gives an empty one. The result has the id and the columns named below;
other columns are not carried.
"""

from __future__ import annotations

from itertools import compress
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, hash_spans, hash_words, split_words, windows
from .ranges import with_id_groups

WIDTH = 13
GROUP_BYTES = 4 << 20
# Bytes of text for each bucket of hashes; there are 256 buckets at least.
BUCKET_BYTES = 4 << 20


def group_windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of some texts, in order; windows and words of each text."""
    hashes, window_counts, word_counts = [np.empty(0, np.uint64)], [np.empty(0, int)], [np.empty(0, int)]
    for block in blocks(texts):
        words = split_words(block)
        starts, counts = windows(words.first, width)
        hashes.append(hash_spans(hash_words(block.data, words), starts, starts + width))
        window_counts.append(counts)
        word_counts.append(np.diff(words.first))
    return np.concatenate(hashes), np.concatenate(window_counts), np.concatenate(word_counts)


def pack(hashes: np.ndarray) -> bytes:
    """Seven bytes of each hash; the leading byte is known from the bucket."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpack(raw: bytes, leading: int) -> np.ndarray:
    out = np.empty((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    out[:, 7] = leading
    return out.reshape(-1).view("<u8")


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                     group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``removed`` (word intervals, end exclusive) and ``kept_text``."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    grouped, total = with_id_groups(plain, "id", "text", group_bytes, "grp")
    bits = max(8, (total // BUCKET_BYTES).bit_length())
    shift = np.uint64(64 - bits)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        hashes = np.unique(group_windows(one_array(table.column("text")), width)[0]) if group >= 0 else np.empty(0, np.uint64)
        buckets = (hashes >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1)) if len(buckets) else np.zeros(1, int)
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({"bucket": pa.array([int(buckets[a]) for a, _ in spans], pa.int32()),
                         "grp": pa.array([group] * len(spans), pa.int32()),
                         "hashes": pa.array([pack(hashes[a:b]) for a, b in spans], pa.binary())})

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        leading = key[0].as_py() >> (bits - 8)
        order = np.argsort(table.column("grp").to_numpy(), kind="stable")
        groups = table.column("grp").to_numpy()[order]
        column = table.column("hashes")
        parts = [unpack(column[int(i)].as_py(), leading) for i in order]
        sizes = np.array([len(p) for p in parts])
        hashes = np.concatenate(parts)
        by_hash = np.argsort(hashes, kind="stable")
        ranked = hashes[by_hash]
        seen = np.zeros(len(hashes), bool)
        seen[by_hash[1:]] = ranked[1:] == ranked[:-1]
        ends = np.cumsum(sizes)
        answers = [(int(g), np.flatnonzero(seen[e - n:e]), int(n)) for g, e, n in zip(groups, ends, sizes)]
        answers = [(g, np.packbits(seen[e - n:e]).tobytes(), n) for (g, hit, n), e in zip(answers, ends) if len(hit)]
        return pa.table({"grp": pa.array([a[0] for a in answers], pa.int32()),
                         "bucket": pa.array([key[0].as_py()] * len(answers), pa.int32()),
                         "n": pa.array([a[2] for a in answers], pa.int32()),
                         "bits": pa.array([a[1] for a in answers], pa.binary())})

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return empty
        table = table.sort_by("id")
        ids, texts = table.column("id").to_numpy(zero_copy_only=False), one_array(table.column("text"))
        hashes, window_counts, word_counts = group_windows(texts, width)
        gone = np.zeros(int(word_counts.sum()) + 1, np.int64)
        if (key[0].as_py() or 0) >= 0 and len(hashes):
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            kinds = np.cumsum(fresh) - 1
            distinct = ranked[fresh]
            earlier = np.zeros(len(distinct), bool)
            buckets = (distinct >> shift).astype(np.int64)
            for bucket, n, raw in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "bits"))):
                begin = int(np.searchsorted(buckets, bucket))
                earlier[begin:begin + n] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
            owner = np.repeat(np.asarray(ids, np.int64), window_counts)
            first_owner = owner[order[fresh]]
            repeated = np.zeros(len(hashes), bool)
            repeated[order] = earlier[kinds] | (first_owner[kinds] < owner[order])
            base = np.repeat(np.cumsum(word_counts) - word_counts - (np.cumsum(window_counts) - window_counts), window_counts)
            at = (np.arange(len(hashes)) + base)[repeated]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + width, -1)
        covered = np.cumsum(gone)[:-1] > 0
        return pa.Table.from_batches(results(table.column("id"), texts, word_counts, covered), schema=empty.schema)

    def results(ids: pa.ChunkedArray, texts: pa.Array, word_counts: np.ndarray, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(word_counts)
        kept, removed, spans = [], [], []
        for text, low, high in zip(texts, ends - word_counts, ends):
            mine = covered[low:high]
            words = text.as_py().split()
            count = int(np.count_nonzero(mine))
            removed.append(count)
            kept.append(b" ".join(compress(words, (~mine).tolist()) if count else words))
            edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)) if count else ()
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
        yield pa.RecordBatch.from_arrays(
            [ids.combine_chunks() if ids.num_chunks != 1 else ids.chunk(0), pa.array(word_counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, empty.schema.field("removed").type), pa.array(kept, pa.binary())], schema=empty.schema)

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    empty = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", span),
                       ("kept_text", pa.binary())]).empty_table()
    entries = grouped.groupBy("grp").applyInArrow(send, "bucket int, grp int, hashes binary")
    answers = entries.groupBy("bucket").applyInArrow(compare, "grp int, bucket int, n int, bits binary")
    kept = grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        remove, "id bigint, n_words bigint, n_removed bigint, removed array<struct<start: int, end: int>>, kept_text binary")
    return kept.select(F.col("id").alias(id_col), "n_words", "n_removed", "removed", F.col("kept_text").cast("string").alias("kept_text"))
