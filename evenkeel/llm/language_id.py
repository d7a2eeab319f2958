"""Language identification by compression.

``fit_dictionaries`` gathers, for each labelled language, whole texts up to ``DICTIONARY_BYTES`` as a raw
zstandard dictionary: those that come first by the hash of their text, short texts before long ones. That
is a bounded sample by intent (``SAMPLE_DOCS``, ``SHORT_BYTES`` and ``DICTIONARY_BYTES`` are the bounds).
``identify`` cuts every whole text into blocks of ``BLOCK_BYTES``, compresses each block with each
dictionary from a fresh start, and adds the sizes up; the language with the smallest sum wins, on a tie the
one with more training texts. Texts and dictionaries are lower-cased, and a run of zero bytes goes ahead of each
block, since zstandard would store a short block as it is. The text is the only input of a prediction.

The score is the share of the winner when a language weighs exp(-bytes over the smallest / SCALE). A text
is rejected when its margin, in bytes and in share of the runner-up's size, is under ``MIN_BYTES`` and
``MIN_SHARE``, and when there is nothing to tell: text null, empty or without a letter gets ``und`` and
score 0, and so does every text when no language was learned. With one language there is no runner-up.
Repeated rows are judged alike; other columns pass through, and those named like the results are replaced.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import portions

SAMPLE_DOCS = 96
SHORT_BYTES = 4096
DICTIONARY_BYTES = 1 << 16
MAX_LANGUAGES = 1024
RANK_PARTS = 64
BLOCK_BYTES = 1 << 13
LEAD = bytes(128)
LEVEL = 3
MIN_MATCH = 4
SCALE = 4.0
MIN_BYTES = 1
MIN_SHARE = 0.002
UNKNOWN = "und"
RESULTS = ("lang_pred", "score", "rejected")


def fit_dictionaries(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """Raw dictionaries by language, the language with most texts first, from rows whose language and text are given."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # Copies of a text count once; only hashes and ids are ranked, so no text is sorted.
    texts = usable.groupBy(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"),
                           (F.octet_length(text_col) > SHORT_BYTES).alias("long")).agg(F.min(id_col).alias("id"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Ranked within parts first, so that no task meets what all partitions hold of one language.
    first = Window.partitionBy("lang", F.pmod("h", F.lit(RANK_PARTS))).orderBy("long", "h", "id")
    few = texts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE_DOCS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).collect()
    order = {(r["lang"], r["h"]): r["rank"] for r in chosen}
    ids = sorted({r["id"] for r in chosen if r["id"] is not None})
    if not ids:
        return {}
    rows = (usable.where(F.col(id_col).isin(ids)).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.lower(text_col).alias("text"))
            .dropDuplicates(["lang", "h"]).collect())
    out: dict[str, bytes] = {}
    for row in sorted((r for r in rows if (r["lang"], r["h"]) in order), key=lambda r: (-counts[r["lang"]], r["lang"], order[r["lang"], r["h"]])):
        have = out.setdefault(row["lang"], b"")
        out[row["lang"]] = (have + row["text"].encode() + b"\n")[:DICTIONARY_BYTES]
    return out


def coders(dictionaries: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    """One compressor for each language, in the order of the dictionaries."""
    plain = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=BLOCK_BYTES, dict_size=DICTIONARY_BYTES, strategy=zstandard.STRATEGY_LAZY, min_match=MIN_MATCH,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    found = []
    for lang in dictionaries:
        data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=plain)
        found.append(zstandard.ZstdCompressor(dict_data=data, compression_params=plain))
    return found


def code_lengths(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text under each dictionary."""
    pieces = [LEAD + text[at:at + BLOCK_BYTES] for at in range(0, len(text), BLOCK_BYTES)]
    return [sum(len(c.compress(piece)) for piece in pieces) for c in compressors]


def decide(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the winner, score and rejection for each row of code lengths."""
    best = sizes.argmin(axis=1)
    low = sizes.min(axis=1)
    score = 1.0 / np.exp((low[:, None] - sizes) / SCALE).sum(axis=1)
    if sizes.shape[1] == 1:
        return best, score, np.zeros(len(sizes), bool)
    second = np.partition(sizes, 1, axis=1)[:, 1]
    margin = second - low
    return best, score, (margin < MIN_BYTES) | (margin < MIN_SHARE * second)


def judge_texts(texts: pa.Array, languages: list[str], compressors: list[zstandard.ZstdCompressor]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of a binary column in which null stands for texts without a letter."""
    lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    rows = [i for i, text in enumerate(texts) if text.is_valid] if languages else []
    if rows:
        sizes = np.array([code_lengths(texts[i].as_py(), compressors) for i in rows], float)
        best, score[rows], rejected[rows] = decide(sizes)
        for row, place in zip(rows, best):
            lang[row] = languages[place]
    return lang, score, rejected


def tellable(text_col: str) -> Column:
    """The text in lower case as bytes, null if it has no letter."""
    return F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col).cast("binary"))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected``; the dictionaries have a fixed bound and are broadcast."""
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rest = [F.col(c) for c in docs.columns if c not in RESULTS]
    inputs = docs.select(*rest, tellable(text_col).alias("_li_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, compressors = list(shipped.value), coders(shipped.value, level)
        for part in (p for batch in batches for p in portions(batch, "_li_text")):
            lang, score, rejected = judge_texts(part.column("_li_text"), languages, compressors)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             names=[*part.schema.names[:-1], *RESULTS])

    schema = inputs.drop("_li_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    for field in schema.fields:
        field.nullable = True
    return inputs.mapInArrow(judge, schema)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """The documents that are not rejected; all columns as they were."""
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, compressors = list(shipped.value), coders(shipped.value, level)
        for part in (p for batch in batches for p in portions(batch, "_li_text")):
            _, _, rejected = judge_texts(part.column("_li_text"), languages, compressors)
            yield pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1]).filter(pa.array(~rejected))

    return docs.withColumn("_li_text", tellable(text_col)).mapInArrow(keep, docs.schema)
