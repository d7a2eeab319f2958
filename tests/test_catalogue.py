"""Every registered query against SQL, with ordinary keys and with every key treated as hot."""

import oracle
import pytest

import __spark_entry__ as entry
from evenkeel import plans
from evenkeel.session import BLOCK_ROWS_CONF, HOT_ROWS_CONF

QUERIES, ORACLES = plans.QUERIES, plans.ORACLES
# Queries that order rows within keys or group them by key, and so treat hot keys differently.
SPREADING = [
    "softmax_by_label", "softmax_by_user", "softmax_cold_by_user", "softmax_sweep",
    "running_cdf", "sample_categorical", "categorical_tiny_weights", "minibatch_per_user", "every_tenth", "trace_shards", "pre_post_pairs", "running_stats", "positive_deltas", "sequence_features", "clamped_fold",
    "clamped_fold_blocks", "level_fold", "level_history", "trace_roundtrip"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", SPREADING)
def test_hot_keys_give_the_same(spark, sf_dir, con, name):
    spark.conf.set(HOT_ROWS_CONF, "3")
    spark.conf.set(BLOCK_ROWS_CONF, "7")
    try:
        assert oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(BLOCK_ROWS_CONF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert plans.QUERIES.keys() <= entry.queries().keys() and plans.ORACLES.keys() <= entry.oracle_sql().keys()
