"""A corpus pipeline: each stage applies one operator to all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of their
input. Rows whose columns are null, empty tables and further columns are met as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm.bpe import encode_decode
from evenkeel.llm.decontaminate import drop_leaks
from evenkeel.llm.language_id import fit_dictionaries, keep_identified
from evenkeel.llm.line_dedup import dedup_lines
from evenkeel.llm.minhash import drop_near_duplicates
from evenkeel.llm.queries import tokenizer_file
from evenkeel.session import work_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; learned from the rows that have one."""
    return keep_identified(docs, fit_dictionaries(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that several of them share."""
    return dedup_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at a similarity of 0.8."""
    return drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the text decoded from them."""
    coded = encode_decode(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

# Compression, fingerprints and merges are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written to the shared folder and read again."""
    folder = work_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
