"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the hashes of its distinct shingles of ``width`` words (A-Z lower-cased; with fewer
words, the whole sequence is one shingle). Two permutations of the 64-bit numbers give all coordinates of a
signature: the first is applied once to every shingle, and coordinate k is the smallest value of the
second one shifted circularly by k places. Bands of ``ROWS`` coordinates put documents into buckets.

1. Documents with equal sets become one class; only its smallest id goes on.
2. In each bucket, every class is compared with the smallest one (a star, so a bucket costs as many pairs as it
   has rows), on the full sets. Confirmed pairs give first components.
3. Where the other members of a bucket still lie in several components, those outside the largest one are compared with all of
   other components, in tiles of at most ``TILE`` by ``TILE``, on the full sets; pairs that are connected by
   then are passed over. So every pair that shares a bucket is either compared or known to be connected.

With 32 bands of 5 rows a pair at a similarity of 0.8 shares no bucket with a chance of 3e-6, and more similar
pairs with less. Shingles are told apart by 64-bit hashes.

Null text, and text without words, has an empty set and is linked with nothing. A row without id is linked with
nothing, has no component and stays. Rows of one id are each judged by their own text; equal rows stay
together. An empty table gives an empty one. Other columns do not matter.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Block, blocks, hash_spans, hash_words, mix, split_words, windows
from .components import connected_components, stored

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 32, 5
TILE = 256
# Texts are hashed in blocks of this many bytes, so that one coordinate's values stay in the processor's cache.
SIGNATURE_BYTES = 1 << 20

FIRST = np.uint64(0x5851F42D4C957F2D)
SECOND = np.uint64(0x2545F4914F6CDD1D)
FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block, repeats included, and their borders between its texts."""
    block = block._replace(data=LOWER[block.data])
    words = split_words(block)
    hashes = hash_words(block.data, words)
    starts, counts = windows(words.first, width)
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    counts[short] = 1
    all_starts = np.empty(int(counts.sum()), np.int64)
    all_ends = np.empty_like(all_starts)
    borders = np.concatenate([[0], np.cumsum(counts)])
    is_short = np.zeros(len(all_starts), bool)
    is_short[borders[short]] = True
    all_starts[~is_short] = starts
    all_ends[~is_short] = starts + width
    all_starts[borders[short]] = words.first[short]
    all_ends[borders[short]] = words.first[short + 1]
    return hash_spans(hashes, all_starts, all_ends), borders


def circulant_signature(hashes: np.ndarray, borders: np.ndarray, size: int) -> np.ndarray:
    """Signatures of the non-empty texts of a block, one row for each."""
    starts = borders[:-1][np.diff(borders) > 0]
    out = np.empty((len(starts), size), np.uint64)
    if len(starts):
        placed = mix(hashes ^ FIRST)
        for k in range(size):
            out[:, k] = np.minimum.reduceat(mix(placed - np.uint64(k)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows) * FACTORS[:rows]
    return mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * SECOND)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, h, n, f1, f2, bands) of documents (id, text, h): size and 128-bit fingerprint of the set, and its buckets."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), SIGNATURE_BYTES):
                hashes, borders = shingles(block, width)
                cuts = borders.tolist()
                sets = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                sizes = np.array([len(s) for s in sets], np.int64)
                firsts = np.array([mix(s ^ SECOND).sum(dtype=np.uint64) for s in sets], np.uint64)
                seconds = np.array([mix(s + FIRST).sum(dtype=np.uint64) for s in sets], np.uint64)
                keys = band_keys(circulant_signature(hashes, borders, BANDS * ROWS), BANDS, ROWS)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(block.low, block.high - block.low), batch.column("h").slice(block.low, block.high - block.low),
                    pa.array(sizes), _longs(firsts), _longs(seconds),
                    pa.ListArray.from_arrays(pa.array(ends), _longs(keys.reshape(-1)))], names=["id", "h", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(sign, "id bigint, h bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of documents (id, text)."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), SIGNATURE_BYTES):
                hashes, borders = shingles(block, width)
                cuts = borders.tolist()
                sets = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(block.low, block.high - block.low),
                                                  pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate(sets)))], names=["id", "shingles"])

    return docs.mapInArrow(collect, "id bigint, shingles array<bigint>")


def shared_buckets(members: DataFrame) -> DataFrame:
    """(key, id, lead) for members (key, id) of the buckets that hold several; lead is the smallest of them."""
    leads = members.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    return members.join(leads, "key").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    mine = sets.select(F.col("id"), F.col("shingles").alias("mine"))
    theirs = sets.select(F.col("id").alias("lead"), F.col("shingles").alias("theirs"))
    n, m, both = F.size("mine"), F.size("theirs"), F.size(F.array_intersect("mine", "theirs"))
    # 100 * both >= percent * (n + m - both), with the costly term once.
    close = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * both >= percent * (n + m))
    return pairs.join(mine, "id").join(theirs, "lead").where(close).select(F.col("id").alias("a"), F.col("lead").alias("b"))


def open_tiles(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(tile, side, id, part) of the buckets whose members (key, id) lie in several components, replicated into tiles of pairs.

    A bucket's largest component is its main side, cut into blocks; the others are the rest, cut into
    blocks too. Tiles pair main blocks with rest blocks, and rest blocks with each other.
    """
    placed = members.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    keys = (counts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.sum("h").alias("h"))
            .where("parts > 1").groupBy("n", "h").agg(F.min(F.struct("key", F.col("main.n").alias("n_main"), F.col("main.part").alias("main"))).alias("k"))
            .select("k.key", "k.main", F.ceil(F.col("k.n_main") / TILE).cast("int").alias("mains"),
                    F.ceil((F.col("n") - F.col("k.n_main")) / TILE).cast("int").alias("rests")))
    sided = placed.join(keys, "key").withColumn("rest", F.col("part") != F.col("main"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    sided = sided.withColumn("block", block)
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(i.alias("x"), F.col("block").alias("y"), F.lit(1).alias("side")))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.struct(
        (-1 - F.least(j, F.col("block"))).alias("x"), F.greatest(j, F.col("block")).alias("y"), F.when(F.col("block") <= j, 0).otherwise(1).alias("side")))
    of_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.struct(F.col("block").alias("x"), j.alias("y"), F.lit(0).alias("side")))
    tiles = F.explode(F.when(F.col("rest"), F.concat(with_main, with_rest)).otherwise(of_main))
    return sided.select("key", "id", "part", tiles.alias("t")).select("key", "t.x", "t.y", "t.side", "id", "part")


def tile_links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a tile, confirmed on full sets."""
    def link(key: tuple, table: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        order = np.argsort(table.column("id").to_numpy())
        ids, parts, sides = (table.column(c).to_numpy()[order].tolist() for c in ("id", "part", "side"))
        column = table.column("shingles")
        sets_of = [frozenset(column[int(i)].values.to_numpy().tolist()) for i in order]
        root = {p: p for p in parts}

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        within = x < 0 and -1 - x == y
        left = range(len(ids)) if within else [i for i, s in enumerate(sides) if s == 0]
        right = range(len(ids)) if within else [i for i, s in enumerate(sides) if s == 1]
        links = []
        for i in left:
            mine = sets_of[i]
            for j in right:
                theirs = sets_of[j]
                if (within and j <= i) or 100 * min(len(mine), len(theirs)) < percent * max(len(mine), len(theirs)):
                    continue
                p, q = find(parts[i]), find(parts[j])
                if p != q:
                    both = len(mine & theirs)
                    if 100 * both >= percent * (len(mine) + len(theirs) - both):
                        root[max(p, q)] = min(p, q)
                        links.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return tiles.join(sets, "id").groupBy("key", "x", "y").applyInArrow(link, "a bigint, b bigint")


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, h, n, component) of every row; h is the hash of its text."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    signed = stored(signatures(texts.withColumn("h", F.xxhash64("text")), width), "minhash")
    linked = signed.where("id is not null and n > 0")
    classes = linked.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    members = linked.join(classes, ["f1", "f2"]).where("id = rep").dropDuplicates(["f1", "f2"]).select("id", F.explode("bands").alias("key"))
    shared = stored(shared_buckets(stored(members, "minhash")), "minhash")
    pairs = stored(shared.where("id <> lead").select("id", "lead").distinct(), "minhash")
    wanted = pairs.select("id").union(pairs.select("lead")).distinct()
    # Candidates grow with the documents, so they are never broadcast, however few they are today.
    sets = stored(shingle_sets(texts.hint("merge").join(wanted, "id", "left_semi"), width), "minhash")
    links = stored(confirmed(pairs, sets, percent), "minhash")
    parts = connected_components(links)
    # All pairs with a lead are settled, so leads need no tile.
    others = shared.where("id <> lead").select("key", "id")
    more = tile_links(open_tiles(others, parts.withColumnRenamed("component", "part")), sets, percent)
    final = connected_components(links.union(more)).select(F.col("id").alias("rep"), "component")
    class_parts = classes.join(final, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return signed.join(class_parts, ["f1", "f2"], "left").select("id", "h", "n", own.alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept`` (no smaller id is reachable)."""
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return _judged(docs, id_col, text_col, width, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Documents with no near duplicate of a smaller id in their group; all columns as they were."""
    gone = _judged(docs, id_col, text_col, width, percent).where("id <> component").select(F.col("id").alias("_nd_id"), F.col("h").alias("_nd_h"))
    same = (F.col(id_col) == F.col("_nd_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) == F.col("_nd_h"))
    return docs.hint("merge").join(gone, same, "left_anti")
