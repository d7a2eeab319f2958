"""The pipeline stage by stage against plain Python, each stage on its own input."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from evenkeel.llm.queries import tokenizer_file
from evenkeel.session import work_path


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, f"test-{name}")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert [s.columns for s in stages[:5]] == [stages[0].columns] * 5


def test_language_id_drops_only_what_tells_nothing(stages):
    before, after = dict(texts(stages[0])), dict(texts(stages[1]))
    assert all(after[i] == before[i] for i in after)
    assert all(len(before[i] or "") < 100 for i in before.keys() - after.keys())


def test_line_dedup(stages):
    want = {i: digest for i, _, _, digest in brute.lines(texts(stages[1]))}
    assert {i: brute.sha(t or "") for i, t in texts(stages[2])} == want


def test_near_dedup(stages):
    groups = brute.components(texts(stages[2]), width=5)
    assert {i for i, _ in texts(stages[3])} == {i for i, (_, c) in groups.items() if i == c}


def test_decontamination(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {doc for doc, _ in brute.leaks(texts(stages[3]), items)}
    assert {i for i, _ in texts(stages[4])} == {i for i, _ in texts(stages[3])} - leaking


def test_encoding_and_run(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    digests = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()))
    want = sorted(brute.coded(texts(stages[4]), tokenizer))
    assert digests(stages[5]) == want
    assert digests(corpus_pipeline.run(spark, sf_dir)) == want


def test_empty_and_awkward_rows(spark, sf_dir, stages):
    """Null texts and languages, rows without id, and columns with the operators' names pass every stage."""
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (None, "one and two", None, None, 3), (3, "the of and then that", "en", "s", 4),
            (3, "the of and then that", "en", "s", 4), (4, "die der und nicht das", "de", None, None)]
    docs = spark.createDataFrame(rows, stages[0].schema).withColumns({"kept": F.lit(1), "score": F.lit("x"), "ids": F.lit(0), "n_tokens": F.lit(2)})
    for given in (docs, docs.where("false")):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            path = work_path(spark, f"test-{name}")
            stage(spark, now, sf_dir).write.parquet(path)
            columns, now = now.columns, spark.read.parquet(path)
            if name != "bpe":
                assert now.columns == columns
        assert {r["doc_id"] for r in now.collect()} <= {1, 2, 3, 4, None}
