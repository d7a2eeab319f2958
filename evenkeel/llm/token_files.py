"""Token ids in binary shards with Elias-Fano coded document boundaries.

A shard is one self-contained run of bytes (``build_shard``): a head, the boundaries of its documents and
their ids as two Elias-Fano sequences, and the concatenated token ids in two or four bytes each.
Documents lie in ascending order of their id, within shards and from shard to shard. Parquet files hold
the shards, one to a row, so that any store Spark can write will do and a lost task leaves nothing behind.

Texts are encoded where they are read, and only packed ids are shuffled, one row for each Arrow batch and
shard. Text is cut before single spaces that follow a non-space, around line breaks between two non-spaces and before marks that follow a letter: a
byte-level pattern always begins a new piece there, so a piece has the same ids in every text. Each distinct piece of a
block of texts is looked up once in a bounded memory, the tokenizers library is asked for those that are not there, and
the ids of all pieces are gathered by number.

Null text is empty and yields the end id alone. Rows without document id come first, in shards without
ids. Rows of one id stay, ordered by their tokens. An empty table gives no shard. The readers return the
columns named there; other columns of the input are not carried.
"""

from __future__ import annotations

import string
import struct
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import elias_fano
from .arrays import Block, blocks
from .bpe import Recent, byte_symbols
from .elias_fano import EliasFano
from .ranges import with_id_groups

SHARD_BYTES = 8 << 20  # of text
MAGIC = b"EFTOKEN1"
HEAD = "<8sBBQQq"  # magic, bytes of a token, whether ids are there, documents, tokens, first id
CACHE_PIECES = 800_000
WORDS_AT_ONCE = 20_000
LONGEST_KNOWN = 64  # bytes of a piece that is remembered
BLOCK_BYTES = 8 << 20  # of text that is cut at once
# Signs that neither begin a contraction nor stand in an added token.
MARKS = "".join(sorted(set(string.punctuation) - set("'<|>")))
MARK = np.isin(np.arange(256), [ord(c) for c in MARKS])
LETTER = np.array([chr(i).isalpha() and i < 0x80 for i in range(256)])
WHITE = np.array([chr(i).isspace() and i < 0x80 for i in range(256)])
WIDE_SPACES = [chr(i).encode() for i in range(0x80, 0x3001) if chr(i).isspace()]
# Not white space by the first byte alone.
BEGINS_WORD = ~WHITE & ~np.isin(np.arange(256), [raw[0] for raw in WIDE_SPACES])


def after_word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places of UTF-8 bytes, none of them the first, follow a sign that is not white space."""
    out = ~WHITE[data[at - 1]]
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    for raw in WIDE_SPACES:
        ends = at[wide]
        fits = ends >= len(raw)
        for back, byte in enumerate(reversed(raw), 1):
            fits &= data[ends - back] == byte  # a place before the first byte wraps, and does not fit anyway
        out[wide[fits]] = False
    return out


def cut(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a block begin, and of each text its first piece; one more entry at the end of both."""
    data, offsets = block.data, block.offsets
    first = np.zeros(len(data) + 2, bool)  # places where a text begins or the block ends
    first[offsets] = True
    spaces = np.flatnonzero((data == 0x20) & ~first[:len(data)])
    spaces = spaces[after_word(data, spaces)]
    breaks = np.flatnonzero((data == 0x0A) & ~first[:len(data)] & ~first[1:len(data) + 1])
    breaks = breaks[after_word(data, breaks) & BEGINS_WORD[data[breaks + 1]]]
    marks = np.flatnonzero(MARK[data] & ~first[:len(data)])
    marks = marks[LETTER[data[marks - 1]]]
    cuts = np.sort(np.concatenate([spaces, breaks, breaks + 1, marks]), kind="stable")
    starts = np.sort(np.concatenate([offsets[:-1], cuts, [len(data)]]), kind="stable")
    return starts, np.searchsorted(cuts, offsets) + np.arange(len(offsets))


def is_word(piece: bytes) -> bool:
    """Letters only, with at most a space before them: one word for the pattern."""
    letters = piece.removeprefix(b" ")
    if letters.isalpha():
        return True
    text = letters.decode()
    return text.isalpha() and max(text) < "\u0250"


class PieceEncoder:
    """Encodes whole texts as the tokenizer does, remembering the ids of pieces."""

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        # The library's model alone, for words that the pattern takes whole: words parted by white space, in byte symbols.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.symbols = {byte: symbol for byte, symbol in enumerate(byte_symbols())}
        self.border = self.tokenizer.model.token_to_id(self.symbols[10])
        self.symbols[10] = f" {self.symbols[10]} "
        self.known = Recent(CACHE_PIECES // 2)

    def _words(self, words: list[bytes]) -> Iterator[bytes]:
        """The packed ids of words of letters, each with the space before it if there is one."""
        for low in range(0, len(words), WORDS_AT_ONCE):
            asked = b"\n".join(words[low:low + WORDS_AT_ONCE]).decode("latin-1").translate(self.symbols)
            ids = np.array(self.model.encode_batch_fast([asked], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(ids == self.border).tolist()
            raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            for start, end in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)]):
                yield raw[start * width:end * width]

    def _answers(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of distinct pieces."""
        answers = [*map(self.known.get, pieces)]
        new = [i for i, found in enumerate(answers) if found is None]
        words = [i for i in new if is_word(pieces[i])]
        for i, found in zip(words, self._words([pieces[i] for i in words])):
            answers[i] = found
        rest = [i for i in new if answers[i] is None]
        asked = [pieces[i].decode() for i in rest]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)):
            answers[i] = np.array(found.ids, self.dtype).tobytes()
        for i in new:
            if len(pieces[i]) <= LONGEST_KNOWN:
                self.known.put(pieces[i], answers[i])
        return answers

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The packed ids of each text of a binary column."""
        width = self.dtype.itemsize
        for block in blocks(texts, BLOCK_BYTES):
            starts, first = cut(block)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [
                None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(block.data))]).dictionary_encode()
            answers = self._answers(pieces.dictionary.to_pylist())
            sizes = np.fromiter(map(len, answers), np.int64, len(answers)) // width
            codes = pieces.indices.to_numpy()
            counts = sizes[codes]
            ends = np.cumsum(counts)
            place = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - counts), counts)
            place += np.arange(len(place))
            tokens = np.frombuffer(b"".join(answers), self.dtype)[place].tobytes()
            borders = (np.concatenate([[0], ends])[first] * width).tolist()
            yield from (tokens[a:b] for a, b in zip(borders[:-1], borders[1:]))


@lru_cache(maxsize=2)
def piece_encoder(tokenizer_file: str) -> PieceEncoder:
    """One for each worker process, so that what it remembers serves later tasks."""
    return PieceEncoder(tokenizer_file)


def build_shard(ids: np.ndarray | None, counts: np.ndarray, tokens: np.ndarray) -> bytes:
    """The bytes of a shard, of documents in order."""
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    first = int(ids[0]) if ids is not None and len(ids) else 0
    parts = [struct.pack(HEAD, MAGIC, tokens.dtype.itemsize, ids is not None, len(counts), len(tokens), first),
             elias_fano.encode(starts, int(starts[-1]) + 1)]
    if ids is not None:
        parts.append(elias_fano.encode(ids - first, int(ids[-1]) - first + 1 if len(ids) else 1))
    return b"".join([*parts, tokens.tobytes()])


class Shard:
    """Reads the bytes of a shard; single documents are found by select, without decoding the rest."""

    def __init__(self, raw: bytes) -> None:
        magic, width, has_ids, self.n_docs, n_tokens, self.first = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.starts = EliasFano(raw, struct.calcsize(HEAD))
        self.ids = EliasFano(raw, self.starts.end) if has_ids else None
        self.tokens = np.frombuffer(raw, f"<u{width}", n_tokens, (self.ids or self.starts).end)

    def document(self, place: int) -> np.ndarray:
        return self.tokens[self.starts.select(place):self.starts.select(place + 1)]

    def doc_id(self, place: int) -> int | None:
        return self.first + self.ids.select(place) if self.ids else None


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes all documents and writes their shards in ascending order of the id."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped, _ = with_id_groups(plain, "id", "text", shard_bytes, "grp")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_file)
        end = np.array([end_id], encoder.dtype).tobytes()
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = list(encoder.encode(batch.column("text").cast(pa.binary())))
            ids, groups = batch.column("id").to_pylist(), batch.column("grp").to_numpy()
            order = np.argsort(groups, kind="stable")
            cuts = np.flatnonzero(np.diff(groups[order], prepend=groups.min() - 1, append=groups.max() + 1)) if len(order) else [0]
            spans = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            width = encoder.dtype.itemsize
            yield pa.RecordBatch.from_arrays([
                pa.array([int(groups[s[0]]) for s in spans], pa.int32()),
                pa.array([np.array([ids[i] or 0 for i in s], "<i8").tobytes() for s in spans], pa.binary()),
                pa.array([np.array([len(raw[i]) // width + 1 for i in s], "<u4").tobytes() for s in spans], pa.binary()),
                pa.array([squeeze.compress(b"".join(part for i in s for part in (raw[i], end))) for s in spans], pa.binary()),
                pa.array([width] * len(spans), pa.int32())], names=["grp", "ids", "counts", "tokens", "width"])

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        group, width = key[0].as_py(), table.column("width")[0].as_py()
        loosen = zstandard.ZstdDecompressor()
        ids = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("ids")])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")]).astype(np.int64)
        tokens = np.frombuffer(b"".join(loosen.decompress(x.as_py()) for x in table.column("tokens")), f"<u{width}")
        ends = np.cumsum(counts)
        parts = [tokens[e - n:e] for e, n in zip(ends, counts)]
        order = np.argsort(ids, kind="stable")
        if (ids[order][1:] == ids[order][:-1]).any():
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], parts[i].tobytes())))
        whole = build_shard(ids[order] if group >= 0 else None, counts[order], np.concatenate([parts[i] for i in order]))
        return pa.table({"shard": pa.array([group], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
                         "n_tokens": pa.array([len(tokens)], pa.int64()), "bytes": pa.array([whole], pa.binary())})

    packed = grouped.mapInArrow(encode, "grp int, ids binary, counts binary, tokens binary, width int")
    shards = packed.groupBy("grp").applyInArrow(shard, "shard int, n_docs bigint, n_tokens bigint, bytes binary")
    # A row is megabytes, so the writer looks at its size after each row and not first after a hundred.
    shards.write.option("compression", "zstd").option("parquet.page.size.row.check.min", "1").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, ``start`` (tokens of all documents before it), ``n_tokens`` and ``ids`` (uint32, little-endian)."""
    shards = spark.read.parquet(path)
    # One number for each shard comes to the driver; there are MAX_CELLS shards at most (see ranges).
    totals = sorted((r["shard"], r["n_tokens"]) for r in shards.select("shard", "n_tokens").collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    offsets = spark.createDataFrame([(s, before[i]) for i, (s, _) in enumerate(totals)],
                                    T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, raw in zip(batch.column("base").to_pylist(), batch.column("bytes")):
                shard = Shard(raw.as_py())
                starts = shard.starts.all()
                tokens = shard.tokens.astype("<u4").tobytes()
                ids = pa.array(shard.ids.all() + shard.first, pa.int64()) if shard.ids else pa.nulls(shard.n_docs, pa.int64())
                cuts = (4 * starts).tolist()
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(starts[:-1] + base, pa.int64()), pa.array(np.diff(starts), pa.int64()),
                    pa.array([tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    return shards.join(F.broadcast(offsets), "shard").select("base", "bytes").mapInArrow(
        decode, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids binary")
