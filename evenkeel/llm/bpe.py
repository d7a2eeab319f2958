"""BPE encoding by a transducer of bounded lookahead, and decoding by a byte-to-text state machine.

Merging in the order of a merge list, what follows a prefix can shift a token border only within a fixed
distance of the prefix's end. ``sufficient_lookahead`` computes that distance from the list, and the
transducer emits a token once it ends farther back; so it holds a bounded number of symbols, however
long the text or a single word is. ``Decoder`` turns ids back into text and holds at most the few
bytes of an unfinished character.

Texts are taken about 2 MB at a time: each distinct run of characters is cut into words once, each distinct word is looked up
once in a bounded memory, the transducer takes the words that are not there together, one merge of each in a step,
and the ids of all texts are gathered by number.

The tokenizer is read from a file of the tokenizers library: a BPE model on byte-level symbols, with an optional suffix for
the last symbol of a word, behind the normaliser and patterns named in ``Vocabulary``. Other kinds are refused.

In a table, null text is empty; empty text has no ids and decodes to empty text. Long texts and long words are
encoded whole. Repeated rows are encoded alike; an empty table gives an empty one; other columns pass
through, and those named like the results are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = ("n_tokens", "ids", "decoded")
CACHE_WORDS = 200_000
# Ids fit so many bits; no merge has a number as large as NO_MERGE.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
PACKED = np.dtype("<i4")
NO_MERGE = 1 << 62
# Longer chunks go through the transducer piece by piece.
LONG_CHUNK = 512
# Longer words, in bytes, go through the transducer one by one.
LONG_WORD = 64
WORDS_AT_ONCE = 20_000
BLOCK_BYTES = 2 << 20  # of text that is encoded at once
CHUNKS_AT_ONCE = 100_000  # of a block or a longer text

# The pattern of the vocabulary's words, and the characters with Unicode's White_Space property.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

BREAK = re.compile(f"[{WHITE_SPACE}]+")
OTHER_SPACE = f"[{WHITE_SPACE.replace(' ', '')}]"
# Python's own splitting takes these four for white space, which Unicode does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORD = regex.compile(WORD_PATTERN)
WORD_OR_END = regex.compile(WORD_PATTERN + "|\n")
LETTERS = regex.compile(r"[\p{L}]+")
OTHERS = regex.compile(r"[^\s\p{L}\p{N}]+")


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


@lru_cache(1)
def joining_characters() -> frozenset[str]:
    """Characters that may combine with what stands before them."""
    found = {chr(c) for c in range(0x1100, 0x1200)}
    for code in range(0x300, 0x110000):
        char = chr(code)
        if unicodedata.combining(char):
            found.add(char)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"]:
            raise ValueError("only plain BPE models are read")
        normal = spec["normalizer"] or {}
        kinds = [step["type"] for step in normal.get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split.get("pattern") != {"Regex": WORD_PATTERN} or not split.get("invert"):
            raise ValueError("the normaliser or the word pattern is not the known one")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.added}.items()}
        self.byte_level_decoder = (spec["decoder"] or {}).get("type") == "ByteLevel"
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        # By both ids in one number: rank and result in one number, so that the smallest is the first merge to apply.
        self.ranks = {a << ID_BITS | b: rank << ID_BITS | whole for rank, (a, b, whole) in enumerate(self.merges)}
        self.inner = [self.ids[s] for s in byte_symbols()]
        self.last = [self.ids[s + self.suffix] for s in byte_symbols()]
        self.added_pattern = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) or "(?!)")
        self.lookahead = sufficient_lookahead(self)


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """How many symbols before the end of a prefix its continuation can shift a border.

    Take two continuations, and the leftmost border d that one of them has and the other has not. A merge (u, v) moves d
    only if d lies in v or at its end, and then to the start of v. With r' the merge that put d where it is, that needs
    v to be the left part of r' (which the other text took away) or the whole of r'. A merge that only grows
    r' to the right, or whose left part r' took away, passes its reach on. Merges act in the order of the list, so one pass
    over it finds the longest reach.
    """
    size = {i: len(t.removesuffix(vocabulary.suffix) if vocabulary.suffix else t) for i, t in vocabulary.tokens.items()}
    by_left: dict[int, int] = {}
    by_right: dict[int, int] = {}
    by_whole: dict[int, int] = {}
    farthest = 1
    made: dict[int, int] = {}
    for rank, (u, v, whole) in enumerate(vocabulary.merges):
        if max(made.get(u, -1), made.get(v, -1)) >= rank or whole in made:
            raise ValueError("merges must build on earlier ones, and each token on one merge")
        made[whole] = rank
        reach = max(size[v] + max(by_left.get(v, 0), by_whole.get(v, 0)), by_whole.get(u, 0), by_right.get(u, 0))
        for table, token in ((by_left, u), (by_right, v), (by_whole, whole)):
            table[token] = max(table.get(token, 0), reach)
        farthest = max(farthest, reach)
    return farthest


def merge(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """Applies the merges in their order, the leftmost first."""
    if len(symbols) > 64:
        return _merge_long(symbols, ranks)
    symbols, get = list(symbols), ranks.get
    offers = [get(a << ID_BITS | b, NO_MERGE) for a, b in zip(symbols, symbols[1:])]
    while offers and (best := min(offers)) < NO_MERGE:
        at = offers.index(best)
        whole = symbols[at] = best & ID_MASK
        del symbols[at + 1], offers[at]
        if at:
            offers[at - 1] = get(symbols[at - 1] << ID_BITS | whole, NO_MERGE)
        if at < len(offers):
            offers[at] = get(whole << ID_BITS | symbols[at + 1], NO_MERGE)
    return symbols


def _merge_long(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """The same in n log n steps: pairs wait in a heap, symbols in a linked list."""
    symbols = list(symbols)
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    waiting: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := ranks.get(symbols[i] << ID_BITS | symbols[j])) is not None:
            heapq.heappush(waiting, (found, i, symbols[i], symbols[j]))

    for i in range(n):
        offer(i)
    while waiting:
        found, i, left, right = heapq.heappop(waiting)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = found & ID_MASK, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s >= 0]


class Recent:
    """A bounded memory in two halves: when the younger one is full it takes the place of the older one."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class WordTransducer:
    """Encodes one word that arrives in parts; keeps a bounded tail."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pending = bytearray()
        size = vocabulary.tokens
        self.size = {i: len(t.removesuffix(vocabulary.suffix) if vocabulary.suffix else t) for i, t in size.items()}
        # The last symbol may yet become the word's last, so it is not known either.
        self.hold = vocabulary.lookahead + 2
        pairs = sorted(vocabulary.ranks.items())
        self.pairs = np.array([pair for pair, _ in pairs] + [NO_MERGE], np.int64)
        self.merged = np.array([found for _, found in pairs] + [NO_MERGE], np.int64)
        self.inner, self.last = np.array(vocabulary.inner, np.int64), np.array(vocabulary.last, np.int64)

    def push(self, raw: bytes) -> list[int]:
        """Takes more bytes; returns the ids that nothing to come can change."""
        out: list[int] = []
        step = 4 * self.hold
        for at in range(0, len(raw), step):
            self.pending += raw[at:at + step]
            if len(self.pending) > 2 * self.hold:
                inner = self.vocabulary.inner
                stable, end = len(self.pending) - self.hold, 0
                for token in merge([inner[b] for b in self.pending], self.vocabulary.ranks):
                    if end + self.size[token] > stable:
                        break
                    end += self.size[token]
                    out.append(token)
                del self.pending[:end]
        return out

    def finish(self) -> list[int]:
        """The ids of the rest of the word."""
        if not self.pending:
            return []
        inner = self.vocabulary.inner
        symbols = [inner[b] for b in self.pending]
        symbols[-1] = self.vocabulary.last[self.pending[-1]]
        self.pending.clear()
        return merge(symbols, self.vocabulary.ranks)

    def whole(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of whole words. Short ones are held to their end anyway, and are finished together."""
        out = [b""] * len(words)
        for low in range(0, len(words), WORDS_AT_ONCE):
            sizes: dict[int, list[int]] = {}
            for i in range(low, min(low + WORDS_AT_ONCE, len(words))):
                if len(words[i]) <= LONG_WORD:
                    sizes.setdefault(len(words[i]), []).append(i)
                else:
                    out[i] = np.array(self.push(words[i]) + self.finish(), PACKED).tobytes()
            self._finish_all(words, sizes, out)
        return out

    def _offers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges of pairs of symbols, or NO_MERGE."""
        pairs = left << ID_BITS | right
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.merged[at], NO_MERGE)

    def _finish_all(self, words: list[bytes], sizes: dict[int, list[int]], out: list[bytes]) -> None:
        """What ``merge`` does, for the words of each size: a step takes all that have so many symbols, and merges one pair in each."""
        most = max(sizes, default=0)
        symbols, offers, place = np.empty((0, most), np.int64), np.empty((0, most), np.int64), np.empty(0, np.int64)
        for width in range(most, 0, -1):
            if width in sizes:
                raw = np.frombuffer(b"".join([words[i] for i in sizes[width]]), np.uint8).reshape(-1, width)
                new = self.inner[raw]
                new[:, -1] = self.last[raw[:, -1]]
                offered = np.full(new.shape, NO_MERGE)  # nothing follows the last symbol
                offered[:, :-1] = self._offers(new[:, :-1], new[:, 1:])
                symbols, offers = np.concatenate([symbols, new]), np.concatenate([offers, offered])
                place = np.concatenate([place, sizes[width]])
            at = offers.argmin(1)  # the leftmost of the smallest
            best = offers[np.arange(len(at)), at]
            goes = best < NO_MERGE
            raw, length = symbols[~goes].astype(PACKED).tobytes(), width * PACKED.itemsize
            for i, start in zip(place[~goes].tolist(), range(0, len(raw), length)):
                out[i] = raw[start:start + length]
            symbols, offers, place, at, best = symbols[goes], offers[goes], place[goes], at[goes], best[goes]
            if width == 1:
                break
            rows = np.arange(len(at))
            symbols[rows, at] = best & ID_MASK
            stays = np.ones(symbols.shape, bool)
            stays[rows, at + 1] = False
            symbols = symbols[stays].reshape(len(at), width - 1)
            stays[rows, at + 1], stays[rows, at] = True, False
            offers = offers[stays].reshape(len(at), width - 1)
            row, pair = rows[at > 0], at[at > 0]
            offers[row, pair - 1] = self._offers(symbols[row, pair - 1], symbols[row, pair])
            row, pair = rows[at < width - 2], at[at < width - 2]
            offers[row, pair] = self._offers(symbols[row, pair], symbols[row, pair + 1])


def normal(text: str) -> str:
    """Composed, in lower case letter by letter (a sigma does not look at its neighbours)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class ChunkTransducer:
    """Encodes one run of characters without white space that arrives in parts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.word = WordTransducer(vocabulary)
        self.raw = ""  # characters that the next ones may still combine with
        self.open: regex.Pattern | None = None  # the pattern of the word that is under way
        self.text = ""  # normal characters that may become 's, 're and the like

    def push(self, part: str, last: bool = False) -> list[int]:
        self.raw += part
        cut = len(self.raw)
        if not last:
            cut -= 1
            while cut > 0 and self.raw[cut] in joining_characters():
                cut -= 1
        ready, self.raw = self.raw[:cut], self.raw[cut:]
        return self._words(self.text + normal(ready), last)

    def _words(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        at = 0
        self.text = ""
        if self.open:
            more = self.open.match(text)
            at = more.end() if more else 0
            out += self.word.push(text[:at].encode())
            if at < len(text) or last:
                out += self.word.finish()
                self.open = None
        while at < len(text):
            if not last and len(text) - at < 3 and text[at] == "'":
                self.text = text[at:]
                break
            found = WORD.match(text, at)
            if not found:  # a control that no pattern takes
                at += 1
                continue
            out += self.word.push(found[0].encode())
            at = found.end()
            kind = None if last or at < len(text) else LETTERS if LETTERS.fullmatch(found[0]) else OTHERS if OTHERS.fullmatch(found[0]) else None
            if kind:
                self.open = kind
            else:
                out += self.word.finish()
        return out


class Encoder:
    """Encodes texts, remembering the ids of short chunks and words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.transducer = WordTransducer(vocabulary)
        self.words = Recent(CACHE_WORDS)
        self.own = {i: i for i in vocabulary.tokens}  # one number for each id, however many words have it

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a run of characters without white space."""
        if self.vocabulary.added_pattern.search(chunk):
            return self._with_added(chunk)
        if len(chunk) > LONG_CHUNK:
            return [i for part in self.stream(chunk) for i in part]
        out: list[int] = []
        for word in WORD.findall(normal(chunk)):
            ids = self.words.get(word)
            if ids is None:
                ids = self.transducer.push(word.encode()) + self.transducer.finish()
                self.words.put(word, tuple([self.own[i] for i in ids]))
            out += ids
        return out

    def stream(self, chunk: str) -> Iterator[list[int]]:
        """The ids of a chunk without added tokens, as they become stable."""
        transducer = ChunkTransducer(self.vocabulary)
        for at in range(0, len(chunk), LONG_CHUNK):
            yield transducer.push(chunk[at:at + LONG_CHUNK])
        yield transducer.push("", last=True)

    def _with_added(self, chunk: str) -> list[int]:
        out, at = [], 0
        for found in self.vocabulary.added_pattern.finditer(chunk):
            if found.start() > at:
                out += self.chunk(chunk[at:found.start()])
            out.append(self.vocabulary.added[found[0]])
            at = found.end()
        return out + (self.chunk(chunk[at:]) if at < len(chunk) else [])

    def encode(self, text: str) -> list[int]:
        return [i for chunk in chunks(text) for i in self.chunk(chunk)]


def chunks(text: str) -> list[str]:
    """The runs of a text without white space."""
    if SEPARATORS.search(text):
        return [chunk for chunk in BREAK.split(text) if chunk]
    return text.split()


class Decoder:
    """Turns ids into text as they come.

    With a byte-level decoder, symbols become bytes and bytes become characters once these are complete; bytes
    that are no UTF-8 become U+FFFD. Without a decoder, tokens are set apart by one space.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = vocabulary.tokens
        self.bytes = {symbol: byte for byte, symbol in enumerate(byte_symbols())} if vocabulary.byte_level_decoder else None
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, ids: list[int]) -> str:
        if self.bytes is None:
            text = " ".join([self.tokens[i] for i in ids])
            text, self.begun = (" " + text if self.begun and ids else text), self.begun or bool(ids)
            return text
        return self.state.decode(bytes(self.bytes[symbol] for i in ids for symbol in self.tokens[i]))

    def finish(self) -> str:
        self.begun = False
        return self.state.decode(b"", final=True) if self.bytes is not None else ""


def gathered(sizes: np.ndarray, values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The values of the runs with these numbers, in their order; ``values`` has all runs one after another."""
    counts = sizes[numbers]
    ends = np.cumsum(counts)
    place = np.repeat((np.cumsum(sizes) - sizes)[numbers] - (ends - counts), counts)
    place += np.arange(len(place))
    return values[place]


class TextCoder:
    """Whole texts to (number of ids, ids in decimal, decoded text), remembering words."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.encoder = Encoder(self.vocabulary)
        self.known = Recent(CACHE_WORDS)
        ids = range(max(self.vocabulary.tokens) + 1)
        self.written = [pa.array([*map(str, ids)]), pa.array([*map(self.vocabulary.tokens.get, ids)], pa.string())]

    def _words(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct words; each that is not remembered goes through the transducer."""
        answers = [*map(self.known.get, words)]
        new = [i for i, found in enumerate(answers) if found is None]
        for i, found in zip(new, self.encoder.transducer.whole([words[i].encode() for i in new])):
            answers[i] = found
            if len(words[i]) <= LONG_WORD:
                self.known.put(words[i], found)
        return answers

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some distinct chunks has, and the ids of all of them."""
        added = pc.match_substring_regex(chunks, self.vocabulary.added_pattern.pattern) if self.vocabulary.added else False
        apart = pc.or_(pc.greater(pc.utf8_length(chunks), LONG_CHUNK), added)
        plain = pc.if_else(apart, "", chunks)
        ended = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), "\n")[0].as_py() + "\n"
        words = pa.array(WORD_OR_END.findall(normal(ended)), pa.string()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        end = distinct.index("\n")
        answers = self._words(distinct[:end] + distinct[end + 1:])
        answers.insert(end, b"")
        sizes = np.array([*map(len, answers)], np.int64) // PACKED.itemsize
        numbers = words.indices.to_numpy()
        ids = gathered(sizes, np.frombuffer(b"".join(answers), PACKED), numbers)
        ends = np.cumsum(sizes[numbers])[numbers == end]
        counts = np.diff(ends, prepend=0)
        alone = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        if len(alone):
            found = [np.array(self.encoder.chunk(chunk), PACKED) for chunk in chunks.take(pa.array(alone)).to_pylist()]
            counts[alone] = [*map(len, found)]
            ids = np.insert(ids, np.repeat(ends[alone], counts[alone]), np.concatenate(found))
        return counts, ids

    def code(self, texts: pa.Array) -> list[pa.Array]:
        """Of each text the number of ids, the ids in decimal and the decoded text."""
        if self.vocabulary.byte_level_decoder:  # characters may span chunks
            ids, decoder = [self.encoder.encode(text) for text in texts.to_pylist()], Decoder(self.vocabulary)
            return [pa.array([*map(len, ids)], pa.int64()), pa.array([" ".join(map(str, found)) for found in ids], pa.string()),
                    pa.array([decoder.push(found) + decoder.finish() for found in ids], pa.string())]
        split = pc.split_pattern(pc.replace_substring_regex(texts, OTHER_SPACE, " "), " ")
        chunks = split.values.dictionary_encode()
        portions = [self._chunks(chunks.dictionary.slice(low, CHUNKS_AT_ONCE)) for low in range(0, len(chunks.dictionary), CHUNKS_AT_ONCE)]
        counts, ids = map(np.concatenate, zip(*portions))
        numbers = chunks.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts[numbers])])[split.offsets.to_numpy()]
        places, chosen = pa.array(ends, pa.int32()), pa.array(gathered(counts, ids, numbers))
        return [pa.array(np.diff(ends)), *(pc.binary_join(pa.ListArray.from_arrays(places, written.take(chosen)), " ") for written in self.written)]


def encode_decode(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (decimal, joined by one space) and ``decoded``."""
    rest = [F.col(c) for c in docs.columns if c not in RESULTS]
    inputs = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).alias("_bpe_text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextCoder(tokenizer_file)
        for batch in batches:
            step = max(1, int(len(batch) * BLOCK_BYTES / max(1, batch.column("_bpe_text").nbytes)))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                columns = coder.code(part.column("_bpe_text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *RESULTS])

    schema = inputs.drop("_bpe_text").withColumns({"n_tokens": F.lit(0).cast("bigint"), "ids": F.lit(""), "decoded": F.lit("")}).schema
    for field in schema.fields:
        field.nullable = True
    return inputs.mapInArrow(code, schema)
