"""Near-duplicate documents by SimHash fingerprints, found through Golay-code fuzzy hashing.

A fingerprint has a bit for each of 64 where over half of the XXH64 values (seed 42) of the text's ``WIDTH``-word
shingles, repeats included, have it set; A-Z are lower-cased, and with fewer words the whole sequence is one
shingle. Fingerprints that differ in at most ``radius`` bits (2 at most) are linked.

The perfect Golay code [23, 12, 7] puts every 23-bit value within three bits of exactly one codeword. A value and
all its one-bit neighbours decode to one codeword or to six; two values within two bits of each other have a common
neighbour (or are neighbours), so they share one of these codewords. Fingerprints are cut into three ``SEGMENTS`` that fit the
code. Of at most two errors one segment is free, so a pair agrees in that segment and shares a codeword index
of the next one: a key is a segment's value with an index of its follower, at most 18 for each fingerprint.

1. Equal fingerprints are one class; its smallest id stands for it.
2. Keys held by 2 to ``BUCKET`` classes are joined, and pairs verified by the bits in which they differ.
3. Classes of larger buckets meet by the fingerprint itself and its 64 one-bit neighbours instead: two fingerprints share
   one of these if and only if they are within two bits, and at most 65 share any one, so a star over each is exact
   and linear. With a radius below 2 the fingerprint alone, or its pairs within a meeting, are verified the same way.
4. Links become components by star contraction (``components``).

Salts (``spark.sql.shuffle.partitions`` of them) spread the rows of a fingerprint or key that very many share.

Null text, and text without words, has fingerprint zero and is linked like any other. Rows of one id are
one document with several texts, linked by each of them. A row without id links nothing and has no component.
An empty table gives an empty one. The result has the columns named below; others are not carried.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, stored

WIDTH = 3
RADIUS = 2
BUCKET = 32
SEED = 42
# Shingles hashed at a time, so that long texts take bounded memory.
PORTION = 1 << 15

# (lowest bit, number of bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

# Length and check bits of the code, and its generator polynomial.
LENGTH, CHECK_BITS, GENERATOR = 23, 11, 0b110001110101


def _remainder(value: int) -> int:
    for place in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if value >> place & 1:
            value ^= GENERATOR << (place - CHECK_BITS)
    return value


LOW_BITS = 12
LOW_SYNDROMES = np.array([_remainder(v) for v in range(1 << LOW_BITS)], np.int64)
HIGH_SYNDROMES = np.array([_remainder(v << LOW_BITS) for v in range(1 << (LENGTH - LOW_BITS))], np.int64)
# The error pattern of each syndrome: the code is perfect, so patterns of up to three bits have one each.
ERRORS = np.zeros(1 << CHECK_BITS, np.int64)
for _bits in (c for n in range(4) for c in combinations(range(LENGTH), n)):
    ERRORS[_remainder(sum(1 << b for b in _bits))] = sum(1 << b for b in _bits)


def decode(values: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword nearest to each 23-bit value."""
    syndromes = LOW_SYNDROMES[values & ((1 << LOW_BITS) - 1)] ^ HIGH_SYNDROMES[values >> LOW_BITS]
    return (values ^ ERRORS[syndromes]) >> CHECK_BITS


def nearby_indices(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords of values and of their one-bit neighbours, sorted in each row, and which of them are first of their kind."""
    flips = np.concatenate([[0], np.left_shift(1, np.arange(bits))]).astype(np.int64)
    found = np.sort(decode(values[:, None] ^ flips), axis=1)
    return found, np.diff(found, axis=1, prepend=-1) != 0


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all fingerprints (uint64), one after another, and their number for each."""
    parts = [((fingerprints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    keys, fresh = [], []
    for k, part in enumerate(parts):
        follower = (k + 1) % len(parts)
        indices, first = nearby_indices(parts[follower], SEGMENTS[follower][1])
        keys.append((k << 40) | (part[:, None] << 12) | indices)
        fresh.append(first)
    wanted = np.concatenate(fresh, axis=1)
    return np.concatenate(keys, axis=1)[wanted], wanted.sum(axis=1)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash of a whole text."""
    words = text.lower().split()  # of bytes: A-Z only, and the six white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[width - 1:].tolist() or [len(joined)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), PORTION):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + PORTION], ends[at:at + PORTION])]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(id, fp) of documents (id, text)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py() or b"", width) for text in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(sign, "id bigint, fp bigint")


def with_keys(classes: DataFrame) -> DataFrame:
    """(key, fp, rep) of classes (fp, rep)."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = golay_keys(batch.column("fp").to_numpy().view(np.uint64))
            rows = pa.array(np.repeat(np.arange(len(batch)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("fp").take(rows), batch.column("rep").take(rows)], names=["key", "fp", "rep"])

    return classes.select("fp", "rep").mapInArrow(spread, "key bigint, fp bigint, rep bigint")


def salt_of(col: str, df: DataFrame) -> Column:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")


def differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links_of(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between representatives of classes (fp, rep) that join all fingerprints within the radius."""
    keys = stored(with_keys(classes), "golay").withColumn("salt", salt_of("fp", classes))
    # Members are counted within salts and then within keys, so no task meets all rows of a key.
    portions = keys.groupBy("key", "salt").agg(F.count("*").alias("n"))
    sizes = portions.groupBy("key").agg(F.sum("n").alias("size")).where("size > 1")
    shared = stored(keys.join(portions.join(sizes, "key").select("key", "salt", "size"), ["key", "salt"]).select("key", "size", "fp", "rep"), "golay")
    small = shared.where(F.col("size") <= BUCKET)
    others = small.select("key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    pairs = small.join(others, "key").where((F.col("rep") > F.col("b")) & (differ("fp", "fp_b") <= radius)).select(F.col("rep").alias("a"), "b")
    crowded = shared.where(F.col("size") > BUCKET).select("fp", "rep").distinct()
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    met = crowded.select("rep", "fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("mid"))
    # At most 65 fingerprints are within one bit of any value.
    circles = met.groupBy("mid").agg(F.collect_list(F.struct("rep", "fp")).alias("all")).where(F.size("all") > 1)
    if radius == RADIUS:
        stars = circles.select(F.array_min(F.transform("all", lambda x: x["rep"])).alias("b"), F.explode("all").alias("x")).select(F.col("x.rep").alias("a"), "b")
    else:
        stars = (circles.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
                 .where((F.col("x.rep") > F.col("y.rep")) & (differ("x.fp", "y.fp") <= radius)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
    return pairs.union(stars).where("a <> b").distinct()


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"a radius of {radius} bits is beyond the code's {RADIUS}")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    signed = stored(with_fingerprints(texts, width), "golay").withColumn("salt", salt_of("id", docs))
    portions = signed.where("id is not null").groupBy("fp", "salt").agg(F.min("id").alias("low"))
    classes = stored(portions.groupBy("fp").agg(F.min("low").alias("rep")), "golay")
    # Rows of one id with different texts tie their classes together.
    several = signed.where("id is not null").groupBy("id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("id")
    ties = (signed.join(several, "id", "left_semi").select("id", "fp").distinct().join(classes, "fp").where("id <> rep")
            .select(F.greatest("id", "rep").alias("a"), F.least("id", "rep").alias("b")))
    found = connected_components(links_of(classes, radius).union(ties))
    whole = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    # The class of a fingerprint reaches its rows by fingerprint and salt.
    placed = portions.join(whole, "fp").select("fp", "salt", "component")
    known = signed.join(placed, ["fp", "salt"], "left")
    return known.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
