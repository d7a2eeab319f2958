"""Accumulators, guarded numbers and arrays on awkward values."""

import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evenkeel.functions import accumulators as A
from evenkeel.functions import draws as SM
from evenkeel.functions import scalars as P
from evenkeel.operators import folds
from evenkeel.operators import softmax as X
from evenkeel.operators import statistics as S

NAN, INF = float("nan"), float("inf")
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")


def stats(df):
    return S.stable_stats(df.withColumn("g", F.lit(1)), "g", "x").first()


def test_mean_survives_cancellation(spark):
    assert stats(values(spark, [1e8, 1.0, 1.0, -1e8]))["mean"] == 0.5


def test_variance_of_one_value_is_zero(spark):
    assert stats(values(spark, [42.0]))["var"] == 0.0


def test_many_tiny_values(spark):
    total = spark.range(10_000).select(F.lit(1e-8).alias("x")).agg(A.exact_sum("x")).first()[0]
    assert float(total) == 1e-4


def test_empty_and_bad_values(spark):
    row = stats(values(spark, [None, NAN, INF, -INF, 1e30, -0.0]))
    assert (row["n"], row["n_bad"], float(row["sum"]), row["mean"], row["var"]) == (1, 4, 0.0, 0.0, 0.0)
    empty = values(spark, []).agg(A.stable_mean("x").alias("m"), A.stable_variance("x").alias("v"), A.all_finite("x").alias("f")).first()
    assert math.isnan(empty["m"]) and empty["v"] == 0.0 and empty["f"]


@FEW
@given(st.lists(st.decimals(min_value=-10_000, max_value=10_000, places=3).map(float), min_size=2, max_size=40), st.integers(1, 5))
def test_stats_do_not_depend_on_layout(spark, xs, parts):
    one, many = stats(values(spark, xs).coalesce(1)), stats(values(spark, list(reversed(xs))).repartition(parts))
    assert one == many
    assert one["var"] == pytest.approx(statistics.variance(xs), rel=1e-9, abs=1e-9)
    assert one["mean"] == pytest.approx(math.fsum(xs) / len(xs), rel=1e-12, abs=1e-12)


def test_variance_far_from_zero(spark):
    xs = [1e9 + x for x in (0.0, 1.0, 2.0)]
    assert values(spark, xs).agg(A.stable_variance("x", 3)).first()[0] == 1.0


def by_group(df):
    return df.withColumn("g", F.lit(1))


@FEW
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, max_value=1e300, min_value=-1e300), min_size=1, max_size=60), st.integers(1, 5))
def test_kahan_is_the_true_sum_in_every_layout(spark, xs, parts):
    """Within a few last bits of the true sum, where the literal recurrence may lose all."""
    want = math.fsum(xs)
    got = [S.kahan_sum(by_group(values(spark, v)).repartition(parts), "g", "x").first()["kahan_sum"] for v in (xs, list(reversed(xs)))]
    assert got[0] == got[1] == pytest.approx(want, rel=1e-15, abs=1e-300)


def test_kahan_on_awkward_values(spark):
    one = lambda xs: S.kahan_sum(by_group(values(spark, xs)), "g", "x").first()["kahan_sum"]
    assert one([1e16, 1.0, -1e16, 3.25, 1e-9, 7.5]) == math.fsum([1e16, 1.0, -1e16, 3.25, 1e-9, 7.5])
    assert one([1e300, 1e-300, -1e300, 5e-324]) == pytest.approx(1e-300)
    assert one([INF, 1.0]) == INF and math.isnan(one([INF, -INF])) and math.isnan(one([NAN, 1.0]))
    assert one([0.0, -0.0, None]) == 0.0


def test_variance_of_wide_ranges(spark):
    for xs in ([1.0, 2e12, 3.0], [9e11] * 50 + [9e11 + 1] * 50, [1e6 + i for i in range(9)], [-1e17, 1e17], [999_999.5, 1_000_000.5, -3.0], [5e17, 5e17 + 128]):
        row = stats(values(spark, xs))
        assert row["n"] == len(xs) and row["n_bad"] == 0
        assert row["var"] == pytest.approx(statistics.variance(xs), rel=1e-9)


def test_variance_of_small_values(spark):
    """Values far below a millionth, alone and beside large ones, by the rounding rule of the sums."""
    for xs in ([1e-9, 2e-9, 7e-9], [3e-10, -4e-10], [-1e-7, 1e-7, 4e-7], [1e-10, 1e10 - 1.0, 1e10 + 1.0], [1e10 - 0.5, 1e10 + 0.5], [2.5e-8] * 3):
        assert stats(values(spark, xs))["var"] == pytest.approx(statistics.variance(xs), rel=1e-9)


def test_spread_of_all_size_classes(spark, sf_dir):
    from evenkeel.plans.statistics import _wide

    wide = _wide(spark, sf_dir).withColumn("size", F.col("event_id") % 3)
    got = {r["size"]: r["var"] for r in S.stable_stats(wide, "size", "value").collect()}
    for size, var in got.items():
        xs = [r["value"] for r in wide.where(F.col("size") == size).select("value").collect() if r["value"] is not None]
        assert math.sqrt(var) == pytest.approx(statistics.stdev([round(x, 10) for x in xs]), rel=1e-9)


def test_one_rounding_rule(spark):
    xs = [5e-11, 100.00000000005, 2.5e-10, 225_179.98000000005, 225_179.97999999995, -3e5 - 5e-11, 1e12 + 0.5]
    df = values(spark, xs)
    for x, row in zip(xs, df.orderBy("i").select(A.quantize("x")).collect()):
        alone = values(spark, [x]).agg(A.exact_sum("x")).first()[0]
        assert alone == row[0]


def test_norms_of_any_size(spark):
    norm = lambda xs: S.global_norm(by_group(values(spark, xs)), "g", "x").first()["norm"]
    assert norm([1e9, 1e9]) == pytest.approx(math.sqrt(2) * 1e9)
    assert norm([1e-8] * 100) == pytest.approx(1e-7) and norm([1e200, 1e200]) == pytest.approx(math.sqrt(2) * 1e200)
    assert math.isnan(norm([NAN, 3.0])) and norm([INF, 1.0]) == INF and norm([0.0, None]) == 0.0
    assert S.global_norm(values(spark, [3.0, 4.0]), [], "x").first()["norm"] == 5.0


def test_distances_that_do_not_fit_are_nan(spark):
    dist = lambda a, b: S.l1_distance(values(spark, [a]), values(spark, [b]), "i", "x").first()["l1"]
    assert math.isnan(dist(1e14, 5e14)) and math.isnan(dist(NAN, 0.5)) and dist(0.25, 0.5) == 0.25 and dist(None, 0.5) == 0.5


def test_log_loss_of_impossible_labels(spark):
    loss = lambda xs: S.log_loss(values(spark, xs), F.col("x")).first()["log_loss"]
    assert loss([0.0, 0.5]) == INF and math.isnan(loss([NAN, 0.0])) and math.isnan(loss([-0.1])) and loss([0.5, None]) == pytest.approx(math.log(2))


def test_tiny_weights(spark):
    from evenkeel.operators import sampling

    df = spark.range(800).select((F.col("id") % 200).alias("g"), F.floor(F.col("id") / 200).alias("k"), F.lit(1e-12).alias("w"))
    drawn = {r["k"] for r in sampling.sample_categorical(df, "g", "k", "w").collect()}
    assert drawn == {0, 1, 2, 3}
    shares = sorted({round(r["cdf"], 9) for r in sampling.running_cdf(df, "g", "k", "w").collect()})
    assert shares == [0.25, 0.5, 0.75, 1.0]


def test_draw_texts_are_unambiguous(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x")], "p string, q string")
    assert len({r[0] for r in df.select(SM.draw_text(1, "d", "p", "q")).collect()}) == 4


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_softmax_with_text_keys_and_nulls(spark, hot_rows):
    df = spark.createDataFrame([(1, k, x) for k, x in (("b", 9.0), ("a", 9.0), (None, 2.0), ("c", None))], "g int, k string, x double")
    cold = {r["k"]: r["p"] for r in X.stable_softmax(df, "g", "k", "x", 1e-9, hot_rows=hot_rows).collect()}
    assert cold == {"a": 1.0, "b": 0.0, "c": 0.0, None: 0.0}
    warm = {r["k"]: r["p"] for r in X.stable_softmax(df, "g", "k", "x", hot_rows=hot_rows).collect()}
    array = df.agg(F.collect_list(F.struct("x")).alias("a")).select(P.softmax_array(F.transform("a", lambda s: s["x"])))
    assert sorted(warm.values()) == pytest.approx(sorted(array.first()[0]))


def test_logsumexp_policies(spark):
    df = values(spark, [1.0, NAN, 2.0]).withColumn("g", F.lit(1))
    expected = math.log(math.exp(1) + math.exp(2))
    assert S.logsumexp(df, "g", "x", on_nan="null").first()["lse"] == pytest.approx(expected)
    assert S.logsumexp(df, "g", "x", on_nan="low").first()["lse"] == pytest.approx(expected)
    with pytest.raises(PySparkException):
        S.logsumexp(df, "g", "x").collect()
    assert S.logsumexp(values(spark, [None]).withColumn("g", F.lit(1)), "g", "x").first()["lse"] is None


@pytest.mark.parametrize("scale", [1.0, 10.0, 100.0, 1e3, 1e4, 1e6])
@pytest.mark.parametrize("hot_rows", [None, 2])
def test_softmax_close_to_plain(spark, scale, hot_rows):
    xs = [0.3, -1.2, 0.7, 0.1, 2.2, -0.4, 1.1, 0.0, -0.9, 0.6]
    df = values(spark, [x * scale for x in xs]).withColumn("g", F.lit(1))
    p = [r["p"] for r in X.stable_softmax(df, "g", "i", "x", hot_rows=hot_rows).orderBy("i").collect()]
    array = df.agg(F.array_agg("x").alias("a")).select(P.softmax_array(F.sort_array("a"))).first()[0]
    kept = [max(-1e6, min(1e6, x * scale)) for x in xs]
    e = [math.exp(x - max(kept)) for x in kept]
    plain = [x / sum(e) for x in e]
    assert sum(abs(a - b) for a, b in zip(p, plain)) <= 1e-3
    assert sum(p) == pytest.approx(1.0, abs=1e-12)
    assert sorted(p) == pytest.approx(sorted(array), abs=1e-12)


def test_cold_softmax_takes_the_first_largest(spark):
    df = spark.createDataFrame([([10.0, 0.1, -0.2],), ([0.0, 5.0, 5.0],), ([NAN, 1.0, INF],)], "a array<double>")
    got = [r[0] for r in df.select(P.softmax_array("a", 1e-9)).collect()]
    assert got == [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_cold_softmax_by_rows_ties(spark, hot_rows):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([3.0, 9.0, 9.0])], "g int, i int, x double")
    got = X.stable_softmax(df, "g", "i", "x", 1e-9, hot_rows=hot_rows).orderBy("i").collect()
    assert [r["p"] for r in got] == [0.0, 1.0, 0.0]


def test_nonfinite_and_clamp(spark):
    df = values(spark, [None, NAN, INF, -INF, 5.0, 50.0])
    got = df.orderBy("i").select(P.is_finite("x"), P.replace_nonfinite("x", 0.0, 1.0, -1.0), P.clamp(P.replace_nonfinite("x"), 0.0, 10.0))
    assert [tuple(r) for r in got.collect()] == [
        (False, None, None), (False, 0.0, 0.0), (False, 1.0, 10.0), (False, -1.0, 0.0), (True, 5.0, 5.0), (True, 50.0, 10.0)]


def test_pick_index_edges(spark):
    df = spark.createDataFrame([([0.2, 0.8, 0.0], 0.1), ([0.2, 0.8, 0.0], 0.2), ([0.2, 0.8, 0.0], 1.0), ([0.0, 0.0, 0.0], 0.5)],
                               "p array<double>, u double")
    assert [r[0] for r in df.select(P.pick_index("p", F.col("u"))).collect()] == [0, 1, 1, 0]


def test_draws_of_one_domain_do_not_move_another(spark):
    keys = spark.range(50)
    env = [r[0] for r in keys.select(SM.uniform_int(0, 6, 99, "env", "id")).collect()]
    both = keys.repartition(7).select("id", SM.uniform(99, "policy", "id"), SM.uniform_int(0, 6, 99, "env", "id")).orderBy("id")
    assert env == [r[2] for r in both.collect()]
    assert len(set(env)) == 6


def test_draws_are_uniform_and_normal(spark):
    got = spark.range(20_000).agg(F.avg(SM.uniform(1, "a", "id")), F.min(SM.uniform(1, "a", "id")), F.max(SM.uniform(1, "a", "id")),
                                  F.avg(SM.normal(1, "b", "id")), F.stddev(SM.normal(1, "b", "id"))).first()
    assert abs(got[0] - 0.5) < 0.01 and got[1] >= 0 and got[2] < 1 and abs(got[3]) < 0.03 and abs(got[4] - 1) < 0.02


def test_ordered_kahan_is_the_literal_recurrence(spark):
    import random

    rng = random.Random(4)
    data = [(rng.choice([1, 2, None]), i, rng.choice([1e16, 1.0, -1e16, 0.1, 3e-9]) * rng.random()) for i in range(30_000)]
    data += [(7, 0, None), (8, 0, float("nan")), (8, 1, 1.0), (9, 0, float("inf")), (9, 1, 5.0)]
    got = {r["k"]: r["kahan_sum"] for r in S.ordered_kahan_sum(spark.createDataFrame(data, "k int, i int, x double").repartition(7), "k", "i", "x").collect()}

    def plain(key):
        s = c = 0.0
        for _, _, x in sorted((r for r in data if r[0] == key), key=lambda r: r[1]):
            if x is not None:
                y = x - c
                t = s + y
                s, c = t, (t - s) - y
        return s

    assert got.keys() == {1, 2, None, 7, 8, 9}
    assert all(repr(got[k]) == repr(plain(k)) for k in got)
    assert S.ordered_kahan_sum(spark.createDataFrame([], "k int, i int, x double"), "k", "i", "x").isEmpty()


def test_scan_of_clamp_steps_equals_the_loop():
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 100, 1000):
        first = rng.random(n) < 0.05
        start, d = rng.integers(0, 50, n) * 1.0, rng.choice([-60.0, -5.5, 0.0, 2.25, 70.0, 1e15, -1e15], n)
        lo = rng.integers(0, 3, n) * 1.0
        hi = lo + rng.integers(0, 60, n)
        state, want = 12.0, []
        for f, s, x, a, b in zip(first, start, d, lo, hi):
            state = min(b, max(a, (s if f else state) + x))
            want.append(state)
        assert np.allclose(folds.states_after(first, start, d, lo, hi, 12.0), want, atol=1e-9)
