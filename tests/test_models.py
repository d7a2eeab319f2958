"""Softmax regression: equal weights for any layout, bad rows, and a model under the gate."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from evenkeel.operators import softmax_fit as S
from evenkeel.operators.fingerprint import table_fingerprint
from evenkeel.plans import models
from evenkeel.sources import snapshots
from evenkeel.streaming import guarded


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").cache()


def test_weights_are_equal_for_any_layout(vectors):
    found = [S.fit_softmax(vectors.repartition(n, F.rand(n)), "embedding", "label", 10, 64, 3, 20.0) for n in (3, 8, 50)]
    for weights, steps in found[1:]:
        assert np.array_equal(weights, found[0][0]) and [s[0] for s in steps] == [s[0] for s in found[0][1]]
    losses = [s.loss for s in found[0][1]]
    assert losses == sorted(losses, reverse=True) and abs(losses[0] - np.log(10)) < 1e-9


def test_gradient_equals_numpy(vectors):
    weights = np.random.default_rng(1).normal(0, 1, (10, 65))
    got = S.measure(vectors, "embedding", "label", weights)
    data = vectors.collect()
    x, y = np.array([r["embedding"] for r in data], float), np.array([r["label"] for r in data])
    z = x @ weights[:, :-1].T + weights[:, -1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    r = p - np.eye(10)[y]
    want = np.concatenate([r.T @ x, r.sum(axis=0)[:, None]], axis=1) / len(y)
    assert np.allclose(got.gradient, want, atol=1e-11) and np.isclose(got.loss, -np.log(p[np.arange(len(y)), y]).mean(), atol=1e-11)
    assert got.n == len(y) and np.isclose(got.norm, np.sqrt((want ** 2).sum()))


def test_bad_rows_are_counted(spark):
    data = [([1.0, 2.0], 0), ([2.0, 1.0], 1), (None, 0), ([1.0], 0), ([1.0, None], 0), ([float("nan"), 1.0], 1), ([float("inf"), 1.0], 1), ([1e30, 0.0], 1),
            ([1.0, 1.0], None), ([1.0, 1.0], 7), ([1.0, 1.0], -1)]
    df = spark.createDataFrame(data, "x array<double>, y int")
    weights, steps = S.fit_softmax(df, "x", "y", 2, 2, 2, 1.0, clip=0.01)
    assert steps[0].n == 2 and steps[0].n_bad == 9
    assert S.norm_of(weights) <= 0.02 + 1e-12
    scored = S.score_softmax(df, "x", weights).collect()
    assert [r["prediction"] is None for r in scored] == [False, False, *[True] * 6, False, False, False]
    again, _ = S.fit_softmax(df, "x", "y", 2, 2, 1, 1.0, start=weights, clip=0.01)
    assert np.array_equal(again, S.fit_softmax(df, "x", "y", 2, 2, 3, 1.0, clip=0.01)[0])
    empty = S.measure(df.where("false"), "x", "y", weights)
    assert empty.n == 0 and empty.loss != empty.loss and not empty.gradient.any()


def test_poisoned_batch_leaves_the_weights(spark, sf_dir):
    root = models.run_guarded_model(spark, sf_dir)
    status = guarded.update_status(spark, root).orderBy("batch_id").collect()
    assert [(r["accepted"], r["reason"], r["base"]) for r in status] == [(True, None, None), (False, "no_bad_rows", 0), (True, None, 0)]
    first, newest = (snapshots.load_snapshot(spark, root, v)["state"] for v in (0, None))
    assert snapshots.latest_version(spark, root) == 2 and snapshots.latest_version(spark, root, below=2) == 0
    assert rows(table_fingerprint(first)) != rows(table_fingerprint(newest))
    assert newest.agg(F.max("n_bad")).first()[0] == 0
