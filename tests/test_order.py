"""Ordered operators: hot keys, NULL keys, folds against brute force, plans."""

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenkeel.operators import folds as D
from evenkeel.operators import ordered as W
from evenkeel.operators import sampling as S
from evenkeel.operators.heat import MAX_HOT_KEYS, split_hot

ORDER = ["ts", "event_id"]
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 1 holds two thirds of the rows, all at one instant; one key is NULL."""
    rnd = random.Random(5)
    data = [(1, 0, i, round(rnd.uniform(-5, 5), 3)) for i in range(400)]
    data += [(None, i, 1000 + i, round(rnd.uniform(-5, 5), 3)) for i in range(60)]
    data += [(2 + i % 20, i, 2000 + i, round(rnd.uniform(-5, 5), 3)) for i in range(140)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k int, ts int, event_id int, x double").repartition(5).cache()


OPERATORS = {
    "number_rows": lambda df, h: W.number_rows(df, "k", ORDER, hot_rows=h),
    "number_rows_desc": lambda df, h: W.number_rows(df, "k", ORDER, desc=True, hot_rows=h),
    "tail": lambda df, h: W.tail_n(df, "k", ORDER, 25),
    "recency": lambda df, h: W.recency_buffer(df, "k", ORDER, 100),
    "head_then_tail": lambda df, h: W.head_then_tail(df, "k", ORDER, 90, 7),
    "shards": lambda df, h: W.shard_index(df, "k", ORDER, 16, hot_rows=h),
    "pairs": lambda df, h: W.pre_post_pairs(df, "k", ORDER, ["x"], ["x"], h),
    "running": lambda df, h: W.running_stats(df, "k", ORDER, "x", h),
    "sequence": lambda df, h: W.sequence_features(df, "k", ORDER, ["x", "ts"], 4, hot_rows=h),
    "minibatch": lambda df, h: S.minibatch(df, "k", ORDER, 5, hot_rows=h),
    "categorical": lambda df, h: S.sample_categorical(df.withColumn("x", F.abs("x")), "k", "event_id", "x", hot_rows=h),
    "clamped": lambda df, h: D.clamped_fold(df, "k", ORDER, "x", -3, 9, 0, hot_rows=h),
    "level": lambda df, h: D.level_fold(df.withColumn("g", F.abs("x")), "k", ORDER, "x", "g", hot_rows=h),
    "history": lambda df, h: D.level_history(df.withColumn("g", F.abs("x")), "k", ORDER, "x", "g", hot_rows=h),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hot_path_equals_plain_path(skewed, name):
    assert rows(OPERATORS[name](skewed, 10_000)) == rows(OPERATORS[name](skewed, 50))


@pytest.mark.parametrize("name", ["pairs", "sequence", "history", "clamped", "level"])
def test_small_blocks(spark, skewed, name):
    plain = rows(OPERATORS[name](skewed, 10_000))
    spark.conf.set("spark.evenkeel.blockRows", "5")
    try:
        assert rows(OPERATORS[name](skewed, 50)) == plain
    finally:
        spark.conf.unset("spark.evenkeel.blockRows")


def test_split_names_hot_keys_only(skewed):
    parts = split_hot(skewed, "k", 50)
    assert {r[0] for r in parts.hot.select("k").distinct().collect()} == {1, None}
    assert parts.hot.count() + parts.cold.count() == skewed.count()
    assert split_hot(skewed, "k", 500).hot is None
    assert MAX_HOT_KEYS == 10_000


def test_hot_rows_lie_in_many_tasks(skewed):
    placed = W.spread(skewed.filter("k = 1"), ["k"], ORDER)
    per_task = [r["count"] for r in placed.groupBy("__chunk").count().collect()]
    assert len(per_task) > 1 and max(per_task) < 400


STEPS = st.lists(st.tuples(st.integers(-4000, 4000), st.integers(0, 9000)), min_size=1, max_size=40)


@FEW
@given(STEPS, st.integers(1, 7))
def test_level_fold_is_the_sequential_rule(spark, steps, block):
    df = spark.createDataFrame([(1, i, d / 1000, g / 1000) for i, (d, g) in enumerate(steps)], "k int, i int, d double, g double")
    hp, max_hp, xp, level, history = 30_000, 30_000, 0, 1, []
    for d, g in steps:
        hp, xp = min(max_hp, max(0, hp + d)), xp + g
        if xp >= 10_000 * level:
            level, max_hp, hp = level + 1, max_hp + 5_000, min(hp + 5_000, max_hp + 5_000)
        history.append((hp, max_hp, xp, level))
    for hot in (None, 0):
        got = D.level_fold(df.repartition(3), "k", "i", "d", "g", hot_rows=hot, block_rows=block).first()
        assert (round(got["hp"] * 1000), round(got["max_hp"] * 1000), round(got["xp"] * 1000), got["level"]) == history[-1]
    steps_got = D.level_history(df, "k", "i", "d", "g", block_rows=block).orderBy("i").collect()
    assert [(round(r["hp"] * 1000), round(r["max_hp"] * 1000), round(r["xp"] * 1000), r["level"]) for r in steps_got] == history


@FEW
@given(st.lists(st.integers(-900, 900), min_size=1, max_size=40), st.integers(1, 6))
def test_clamped_fold_blocks(spark, deltas, block):
    df = spark.createDataFrame([(1, i, d / 100) for i, d in enumerate(deltas)], "k int, i int, d double")
    x = 300
    for d in deltas:
        x = min(1000, max(0, x + d))
    plain = D.clamped_fold_plain(df, "k", "i", "d", 0, 10, 3).first()
    blocks = D.clamped_fold(df.repartition(3), "k", "i", "d", 0, 10, 3, hot_rows=0, block_rows=block).first()
    assert round(plain["state"] * 100) == round(blocks["state"] * 100) == x


def test_falling_experience_is_refused(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.0, -1.0)], "k int, i int, d double, g double")
    with pytest.raises(PySparkException):
        D.level_fold(df, "k", "i", "d", "g").collect()


def test_recover_flag(spark):
    df = spark.createDataFrame([(0.0, 30.0), (29.0, 30.0), (10.0, 39.0)], "hp double, max_hp double")
    assert [r["hp"] for r in D.recover_all(df).collect()] == [3.0, 30.0, 13.0]
    assert [r["hp"] for r in D.recover_all(df, stop_at_floor=True).collect()] == [0.0, 30.0, 13.0]


def test_sequence_modes(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "k int, i int, x double")
    now = W.sequence_features(df, "k", "i", ["x"], 3, "current_only").orderBy("i").collect()
    assert [r["seq"] for r in now] == [[[0.0], [0.0], [5.0]], [[0.0], [0.0], [6.0]]]
    then = W.sequence_features(df, "k", "i", ["x"], 3).orderBy("i").collect()
    assert [r["seq"] for r in then] == [[[0.0], [0.0], [5.0]], [[0.0], [5.0], [6.0]]]
    with pytest.raises(ValueError):
        W.sequence_features(df, "k", "i", ["x"], 3, "other")


def test_minibatch_needs_enough_rows(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(4 if k == 1 else 3)], "k int, i int")
    got = S.minibatch(df, "k", "i", 4).collect()
    assert {r["k"] for r in got} == {1} and len(got) == 4


def test_promote_is_nested_in_p(events):
    few = {r[0] for r in S.promote(events, "event_id", 0.05).select("event_id").collect()}
    more = {r[0] for r in S.promote(events.repartition(3), "event_id", 0.3).select("event_id").collect()}
    assert few and few < more


def test_categorical_fallbacks(spark):
    df = spark.createDataFrame([("zero", "a", 0.0), ("zero", "b", 0.0), ("nan", "a", 1.0), ("nan", "b", float("nan")),
                                ("one", "a", 0.0), ("one", "b", 2.0), ("one", "c", 0.0)], "g string, k string, w double")
    got = {r["g"]: r["k"] for r in S.sample_categorical(df, "g", "k", "w").collect()}
    assert got["zero"] == "a" and got["nan"] == "b" and got["one"] == "b"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_use_one_shuffle_and_no_python(events):
    slim = events.select("user_id", "ts", "event_id", "value")
    for df in (W.running_stats(slim, "user_id", ORDER, "value"), W.pre_post_pairs(slim, "user_id", ORDER, ["value"]),
               D.clamped_fold(slim, "user_id", ORDER, "value", 0, 10, 0)):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1, text
        assert "SinglePartition" not in text and "Python" not in text and "InPandas" not in text


def test_selections_run_no_job_while_built(spark, events):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    slim, before = events.select("user_id", "ts", "event_id"), jobs()
    built = [W.tail_n(slim, "user_id", ORDER, 40), W.recency_buffer(slim, "user_id", ORDER), W.head_then_tail(slim, "user_id", ORDER)]
    assert jobs() == before
    for df in built:
        assert plan(df).count("Exchange hashpartitioning") == 2


def test_tail_limits_before_the_shuffle(events):
    assert "WindowGroupLimit" in plan(W.tail_n(events.select("user_id", "ts", "event_id"), "user_id", ORDER, 40))
