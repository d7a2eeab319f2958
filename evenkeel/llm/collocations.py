"""Collocations: phrases that occur more often than their parts let expect, counted with HAT-tries.

A-Z are lower-cased; ``PIECE_ENDS`` cut a text into pieces and spaces and tabs cut these into words. All figures
are per language (null: ``und``): n counts words, f(phrase) all its occurrences within pieces, overlaps included. Phrases of 2 to
``MAX_WORDS`` words with a = f(phrase) >= ``MIN_COUNT`` are candidates. Cut after its first words a candidate scores
floor(1000 a n / (l r)), with l and r the counts of both parts, in decimals of 38 digits; its lowest cut counts, on a tie the first.
Candidates inside a longer candidate that is at least ``ABSORB`` percent as frequent are dropped.

A phrase cannot be more frequent than a part of it, nor than all that shares its hash. So the texts are passed four times: words are counted;
pairs are counted by buckets of their hash (``pair_sketch``); the pairs of buckets that reach the least count are counted themselves; and of longer
phrases those whose pairs are all frequent, as far as a bit filter can tell. There are ``PAIRS_PER_BUCKET`` words to a bucket and 16 bits to a filter's
entry, up to 2**28 (32 MB of bits); in corpora beyond that more is counted, with the same results.

Every task counts with a ``HatTrie``: words get ids of the task; hash containers hold the rests of phrases and burst into a node by the
next word when they grow past ``BURST``, so a shallow trie of word ids stands over them. Past ``MAX_ENTRIES`` entries the largest
subtrees are spilled whole, as sorted runs. Runs are dealt by a hash of the first two words, and Spark adds them
up within these partitions, on disk where they are large. Nothing of this depends on one hot word: a prefix is shared by phrases, not by
occurrences, which are added up before.

Null or empty text has no words. Repeated rows count as often as they occur; ids play no part. Texts longer than ``LONG_BYTES`` are
cut at ends of pieces. An empty table gives an empty result. The result has the columns named below; others do not matter.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BASE, BYTE_VALUES, LOWER, Block, blocks, hash_spans, hash_words, mix, runs, split_words, windows
from .components import stored

MAX_WORDS = 5
MIN_COUNT = 100
ABSORB = 100
TOP = 2000
UNKNOWN = "und"
LONG_BYTES = 8 << 20
RANK_PARTS = 64

# Of a task's trie: entries of a container, of all containers, and words that have an id.
BURST = 1 << 12
MAX_ENTRIES = 1 << 19
MAX_IDS = 1 << 19
# Rows of a run that leave a task at a time, and bytes of text that are taken in at a time.
RUN_ROWS = 1 << 16
TEXT_BYTES = 1 << 21
ID = np.dtype(">u4")

FILTER_BITS_PER_ENTRY = 16
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 28
PAIRS_PER_BUCKET = 8
# Pairs of a task that are put in order at a time, and the shares of the buckets that are added up apart.
SKETCH_PAIRS, SKETCH_PARTS = 1 << 22, 1 << 6

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[list(PIECE_ENDS)] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[[9, 32]] = False

RUN = "lang string, prefix int, phrase string, n bigint"


class Node:
    """A branching by the next word id."""

    __slots__ = ("children",)

    def __init__(self) -> None:
        self.children: dict[bytes, Node | dict[bytes, int]] = {}


class HatTrie:
    """Counts of phrases, given as concatenated word ids of four bytes each.

    Containers are dicts from the rest of a phrase to its count; nodes stand over those that burst, ``depth`` at most on a path.
    """

    def __init__(self, depth: int, burst: int = BURST) -> None:
        self.depth, self.burst = depth, burst
        self.roots: dict[object, Node | dict[bytes, int]] = {}
        self.size = 0

    def add(self, lang: object, keys: list[bytes], counts: list[int]) -> None:
        """Add counts of phrases; those with the same first words should lie side by side."""
        reach, last, box, at, before = 4 * self.depth, None, {}, 0, 0
        for key, n in zip(keys, counts):
            if last is None or key[:reach] != last:
                self.size += len(box) - before
                last = key[:reach]
                box, at = self._container(lang, key)
                before = len(box)
            rest = key[at:]
            box[rest] = box.get(rest, 0) + n
        self.size += len(box) - before

    def _container(self, lang: object, key: bytes) -> tuple[dict[bytes, int], int]:
        """The container for a phrase, burst first if it has grown too large, and where the rest begins."""
        holder, name, at = self.roots, lang, 0
        while True:
            box = holder.setdefault(name, {})
            if type(box) is dict:
                if len(box) <= self.burst or at == 4 * self.depth:
                    return box, at
                holder[name] = box = self._burst(box)
            holder, name = box.children, key[at:at + 4]
            at += 4

    @staticmethod
    def _burst(box: dict[bytes, int]) -> Node:
        node = Node()
        for rest, n in box.items():
            node.children.setdefault(rest[:4], {})[rest[4:]] = n
        return node

    def spill(self, keep: int) -> Iterator[tuple[object, list[bytes], list[int]]]:
        """Remove whole subtrees, the largest first, until ``keep`` entries stay: language, phrases and counts of each."""
        found = [(count(box), holder, name, lang, head) for holder, name, lang, head, box in self._subtrees()]
        for size, holder, name, lang, head in sorted(found, key=lambda x: -x[0]):
            if self.size <= keep:
                break
            self.size -= size
            yield lang, *entries(holder.pop(name), head)

    def _subtrees(self) -> Iterator[tuple]:
        for lang, root in self.roots.items():
            if type(root) is dict:
                yield self.roots, lang, lang, b"", root
            else:
                for word, box in root.children.items():
                    yield root.children, word, lang, word, box


def count(box: Node | dict) -> int:
    return len(box) if type(box) is dict else sum(map(count, box.children.values()))


def entries(box: Node | dict, head: bytes) -> tuple[list[bytes], list[int]]:
    """All phrases of a subtree, with the words on the way to it, and their counts."""
    if type(box) is dict:
        return [head + rest for rest in box], list(box.values())
    keys, counts = [], []
    for word, child in box.children.items():
        more, n = entries(child, head + word)
        keys += more
        counts += n
    return keys, counts


class Filter(NamedTuple):
    """Which word sequences may be frequent: a bit for each hash."""

    bits: np.ndarray  # packed
    log2: int

    def known(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - self.log2)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def pair_hashes(word_hashes: np.ndarray) -> np.ndarray:
    return mix(word_hashes[:-1] + word_hashes[1:] * np.uint64(BASE))


def in_one_piece(data: np.ndarray, block: Block, starts: np.ndarray) -> np.ndarray:
    """Which words lie in one piece with the word that follows."""
    breaks = np.zeros(len(data) + 1, np.int32)
    breaks[:-1] = ENDS_PIECE[data]
    breaks[block.offsets[:-1]] += 1
    piece = np.cumsum(breaks)[starts]
    return piece[1:] == piece[:-1]


class Counter:
    """The phrases of one task, of ``shortest`` to ``longest`` words; ``needed`` tells which pairs may be frequent."""

    def __init__(self, shortest: int, longest: int, needed: Filter | None) -> None:
        self.shortest, self.longest, self.needed = shortest, longest, needed
        self.reset()

    def reset(self) -> None:
        self.trie = HatTrie(depth=min(2, self.shortest - 1))
        self.ids: dict[bytes, int] = {}
        self.hashes: list[int] = []

    def add(self, lang: str, block: Block) -> None:
        data = LOWER[block.data]
        words = runs(IN_WORD[data], block.offsets)
        if not len(words.starts):
            return
        # Word bytes lie side by side once the others are left out, so Arrow can tell words apart exactly.
        sizes = words.ends - words.starts
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[IN_WORD[data]])])
        coded = column.dictionary_encode()
        places, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        borders = np.frombuffer(vocabulary.buffers()[1], np.int32, len(vocabulary) + 1)
        one_of = hash_spans(BYTE_VALUES[np.frombuffer(vocabulary.buffers()[2], np.uint8)[:borders[-1]]], borders[:-1], borders[1:])
        hashes = one_of[places]
        for rows, counts in self._distinct(lang, data, block, words, hashes, places, len(vocabulary)):
            used = np.unique(rows)
            task_ids = np.zeros(len(vocabulary), ID)
            task_ids[used] = self._task_ids(vocabulary.take(pa.array(used)).to_pylist(), one_of[used].tolist())
            keys = np.ascontiguousarray(task_ids[rows])
            self.trie.add(lang, keys.view(f"V{4 * rows.shape[1]}").reshape(-1).tolist(), counts.tolist())

    def _task_ids(self, words: list[bytes], hashes: list[int]) -> list[int]:
        known, out = self.ids, []
        for word, h in zip(words, hashes):
            place = known.get(word)
            if place is None:
                place = known[word] = len(known)
                self.hashes.append(h)
            out.append(place)
        return out

    def _distinct(self, lang: str, data: np.ndarray, block: Block, words, hashes: np.ndarray, places: np.ndarray, n_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct phrases of each length as rows of places in the vocabulary, with their counts."""
        if self.shortest == 1:
            found, counts = np.unique(places, return_counts=True)
            yield found[:, None], counts
            return
        good = in_one_piece(data, block, words.starts)
        good &= self.needed.known(mix(pair_hashes(hashes) ^ seed_of(lang)))
        starts = np.flatnonzero(good)
        codes, rows = places[starts], np.arange(n_words)[:, None]
        for length in range(2, self.longest + 1):
            if length > 2:
                on = starts + length - 2 < len(good)
                on[on] = good[starts[on] + length - 2]
                starts, codes = starts[on], codes[on]
            found, codes, counts = np.unique(codes * n_words + places[starts + length - 1], return_inverse=True, return_counts=True)
            rows = np.concatenate([rows[found // n_words], (found % n_words)[:, None]], axis=1)
            if length >= self.shortest and len(rows):
                yield rows, counts

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees, or of all that is left."""
        if not self.trie.size:
            return
        vocabulary, hashes = pa.array(list(self.ids), pa.string()), np.array(self.hashes, np.uint64)
        held: dict[object, tuple[list[bytes], list[int]]] = {}
        for lang, keys, counts in self.trie.spill(keep):
            mine = held.setdefault(lang, ([], []))
            mine[0].extend(keys)
            mine[1].extend(counts)
            if len(mine[0]) >= RUN_ROWS:
                yield from self._run(lang, *held.pop(lang), vocabulary, hashes)
        for lang, (keys, counts) in held.items():
            yield from self._run(lang, keys, counts, vocabulary, hashes)

    def _run(self, lang: str, keys: list[bytes], counts: list[int], vocabulary: pa.Array, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Some subtrees of one language as a sorted run, lengths apart."""
        sizes, n = np.fromiter(map(len, keys), np.int64, len(keys)) // 4, np.array(counts, np.int64)
        whole = np.frombuffer(b"".join(keys), ID)
        starts = np.cumsum(sizes) - sizes
        for length in range(self.shortest, self.longest + 1):
            mine = np.flatnonzero(sizes == length)
            if not len(mine):
                continue
            ids = whole[starts[mine, None] + np.arange(length)].astype(np.int64)
            order = np.lexsort(ids.T[::-1])
            ids = ids[order]
            columns = [vocabulary.take(pa.array(ids[:, i])) for i in range(length)]
            phrases = pc.binary_join_element_wise(*columns, " ") if length > 1 else columns[0]
            first = hashes[ids[:, 0]]
            prefix = first if length == 1 else mix(first + hashes[ids[:, 1]] * np.uint64(BASE))
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang, pa.string()), len(ids)), pa.array((prefix >> np.uint64(33)).astype(np.int32)), phrases, pa.array(n[mine][order])],
                names=["lang", "prefix", "phrase", "n"])


def in_portions(texts: pa.Array) -> pa.Array:
    """A binary column in which long texts are cut after ends of pieces into several rows."""
    if not len(texts) or (pc.max(pc.binary_length(texts)).as_py() or 0) <= LONG_BYTES:
        return texts
    rows: list[bytes] = []
    for value in texts:
        text, at = value.as_py() or b"", 0
        while len(text) - at > LONG_BYTES:
            end = 1 + max(text.rfind(sign, at, at + LONG_BYTES) for sign in map(bytes, zip(PIECE_ENDS)))
            if not end:
                after = [x for x in (text.find(sign, at) for sign in map(bytes, zip(PIECE_ENDS))) if x >= 0]
                end = 1 + min(after) if after else len(text)
            rows.append(text[at:end])
            at = end
        rows.append(text[at:])
    return pa.array(rows, pa.binary())


def counted(docs: DataFrame, shortest: int, longest: int, needed: Filter | None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(lang, phrase, f) of documents (lang, text): counts of phrases that may be frequent."""
    shipped = docs.sparkSession.sparkContext.broadcast(needed)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shortest, longest, shipped.value)
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for place, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, place))
                for block in blocks(in_portions(texts), TEXT_BYTES):
                    counter.add(lang, block)
                    if len(counter.ids) > MAX_IDS:
                        yield from counter.spill(0)
                        counter.reset()
                    elif counter.trie.size > max_entries:
                        yield from counter.spill(max_entries // 2)
        yield from counter.spill(0)

    runs_of_tasks = docs.mapInArrow(tally, RUN).repartition("lang", "prefix")
    return runs_of_tasks.groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("f")).drop("prefix")


def pair_sketch(docs: DataFrame, n_words: int, min_count: int) -> Filter:
    """The buckets of pair hashes that ``min_count`` pairs of documents (lang, text) fall into; a frequent pair is in one of them.

    Tasks send the buckets they hit, sorted and packed; each share of the buckets is added up by one task, row by row. What comes
    to the driver is a bit for each bucket.
    """
    log2 = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, n_words // PAIRS_PER_BUCKET)).bit_length() - 1
    share = (1 << log2) // SKETCH_PARTS

    def packed_rows(held: list[np.ndarray]) -> pa.RecordBatch:
        places, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(places, np.arange(SKETCH_PARTS + 1) * share)
        parts = [p for p in range(SKETCH_PARTS) if cuts[p] < cuts[p + 1]]
        squeeze = zstandard.ZstdCompressor(level=1)
        rows = []
        for p in parts:
            at = slice(cuts[p], cuts[p + 1])
            both = np.stack([np.diff(places[at], prepend=p * share), counts[at]]).astype("<u4")
            # Bytes of equal weight lie side by side, so the many zeros vanish.
            rows.append(squeeze.compress(both.reshape(-1).view(np.uint8).reshape(-1, 4).T.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for place, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, place))
                for block in blocks(in_portions(texts), TEXT_BYTES):
                    data = LOWER[block.data]
                    words = runs(IN_WORD[data], block.offsets)
                    if len(words.starts) < 2:
                        continue
                    hashes = mix(pair_hashes(hash_words(data, words)) ^ seed_of(lang))[in_one_piece(data, block, words.starts)]
                    held.append((hashes >> np.uint64(64 - log2)).astype(np.int64))
                    size += len(held[-1])
                    if size >= SKETCH_PAIRS:
                        yield packed_rows(held)
                        held, size = [], 0
        if size:
            yield packed_rows(held)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loosen = np.zeros(share, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for raw in batch.column("counts"):
                flat = np.frombuffer(loosen.decompress(raw.as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(2, -1)
                total[np.cumsum(flat[0].astype(np.int64))] += flat[1]
        bits = np.packbits(total >= min_count, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], names=["part", "bits"])

    rows = docs.mapInArrow(tally, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, bits binary").collect()
    bits = np.zeros((SKETCH_PARTS, share // 8), np.uint8)
    for row in rows:
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits.reshape(-1), log2)


def filter_of(pairs: DataFrame) -> Filter:
    """The filter for stored pairs (lang, phrase)."""
    size = pairs.count()
    log2 = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, FILTER_BITS_PER_ENTRY * size)).bit_length() - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for at, lang in enumerate(langs.dictionary.to_pylist()):
                mine = batch.column("phrase").filter(pc.equal(langs.indices, at)).cast(pa.binary())
                for block in blocks(mine):
                    words = split_words(block)
                    hashes = pair_hashes(hash_words(block.data, words))[windows(words.first, 2)[0]]
                    bits = (mix(hashes ^ seed_of(lang)) >> np.uint64(64 - log2)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bits)], names=["bit"])

    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    rows = pairs.mapInArrow(place, "bit bigint").groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(word).alias("bits")).toArrow()
    bits = np.zeros(1 << (log2 - 6), np.int64)
    bits[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return Filter(bits.view(np.uint8), log2)


def words_of(phrase: str) -> Column:
    return F.split(phrase, " ")


def part_of(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def best_cuts(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, n, score, k, l, r) of candidates (lang, phrase, a): the cut with the lowest score."""
    words = words_of("phrase")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(
        k.alias("k"), part_of(words, F.lit(1), k).alias("first"), part_of(words, k + 1, F.size(words) - k).alias("rest"))))
    cuts = candidates.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.*")
    lefts = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    # The score is at most 10 n, so it fits where n does; the products need up to 38 digits.
    joined = cuts.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"]).join(totals, "lang").withColumns(
        {"up": F.lit(1000).cast("decimal(38,0)") * wide["a"] * wide["n"], "down": wide["l"] * wide["r"]})
    scored = joined.withColumn("score", F.expr("up div down"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("x")
    return scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "n", "x.*")


def absorbed(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent longer candidate around a phrase."""
    words = words_of("phrase")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda length: F.transform(
        F.sequence(F.lit(1), F.size(words) - length + 1), lambda start: part_of(words, start, length))))
    return (candidates.where(F.size(words) > 2).select("lang", "a", F.explode(inner).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                      absorb: int = ABSORB, top: int = TOP, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, count and text."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    frequent = F.col("f") >= min_count
    words = stored(counted(texts, 1, 1, None, max_entries), "collocations")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "collocations")
    single = words.where(frequent)
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    candidates = stored(counted(texts, 2, 2, pair_sketch(texts, n_words, min_count), max_entries).where(frequent), "collocations")
    if max_words > 2:
        pairs = candidates
        candidates = pairs.union(stored(counted(texts, 3, max_words, filter_of(pairs), max_entries).where(frequent), "collocations"))
    counts = single.union(candidates)
    named = candidates.select("lang", "phrase", F.col("f").alias("a"))
    scored = best_cuts(named, counts, totals).join(absorbed(named), ["lang", "phrase"], "left")
    stay = scored.where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked within parts first, so that no task sorts all phrases of one language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = stay.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
