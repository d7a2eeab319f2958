"""The registered queries over the smallest tables, against SQL or plain Python."""

import brute
import oracle
import pytest

from evenkeel.llm import queries

TOKENIZERS = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name]) == []


def test_languages(spark, sf_dir):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(langs)
    assert all(0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert tested and sum(r["lang_pred"] == langs[r["doc_id"]] for r in tested) / len(tested) >= 0.97


def test_leaks(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in queries.QUERIES["op2_decontaminate"](spark, sf_dir).collect()}
    assert found == {k: round(v, 9) for k, v in brute.leaks(docs, items).items()}


def test_quality(spark, sf_dir, docs):
    rows = queries.QUERIES["op3_quality_rules"](spark, sf_dir).collect()
    assert {r[0]: tuple(r[1:7]) for r in rows} == brute.quality_base(docs)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(r["kept"], quality[r["doc_id"]]) for r in rows if r["doc_id"] in quality and not r["base_failed"]]
    assert sum(kept == bool(good) for kept, good in judged) / len(judged) >= 0.95


def test_near_duplicates(spark, sf_dir, docs):
    rows = queries.QUERIES["op4_minhash_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.components(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_word_bpe(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZERS.path("word_bpe_49k.json"))
    assert sorted(map(tuple, queries.QUERIES["op5_bpe"](spark, sf_dir).collect())) == sorted(brute.coded(docs, tokenizer))


def test_personal_data(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_pii"](spark, sf_dir).collect()}
    for doc, text in docs:
        counts, base = brute.personal(text)
        row = rows[doc]
        assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == counts
        assert row["base_sha256"] == brute.sha(base)
        assert [s for s in row["spans"].split(",") if not s.startswith("term:")] == base.split(",")


def test_token_files(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZERS.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, queries.QUERIES["op9_token_files"](spark, sf_dir).collect())) == brute.token_rows(docs, tokenizer)


def test_golay_simhash(spark, sf_dir, docs):
    rows = queries.QUERIES["op12_golay_simhash"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.fingerprint_groups(docs))


def test_collocations_in_full(spark, sf_dir):
    """The SQL and the query agree; at this size few phrases reach 100, so lower counts are compared as well."""
    from evenkeel.llm.collocations import mine_collocations

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    for least in (100, 4):
        assert sorted(map(tuple, mine_collocations(docs, min_count=least).collect())) == brute.collocations(rows, least)
