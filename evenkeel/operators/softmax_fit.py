"""Softmax regression whose weights are equal to the last bit for any layout of the rows, on any number of tasks.

A step needs sums over all rows: the gradient, the loss and the count. Every row's share is computed by elementwise operations in a
fixed order and rounded to whole units of 2**-40; Spark adds the units up as whole numbers, so the order in which tasks and
merges come does not matter. Weights, sums and steps have the size of the model and live on the driver.

A row whose features are missing, not of the model's length, not finite or beyond ``LIMIT``, or whose label is no class, is counted
as bad and left out.
"""

from __future__ import annotations

from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 1 << 40
LIMIT = float(1 << 20)
HALF_BITS = 30
# Rows whose gradient shares are in memory at once.
CHUNK = 1 << 10

STATE = "cls int, weights array<double>, loss double, norm double, n bigint, n_bad bigint"


class Step(NamedTuple):
    """What all rows say about some weights: mean loss and gradient, its norm, and how many rows there were."""

    loss: float
    gradient: np.ndarray
    norm: float
    n: int
    n_bad: int


def zero_weights(classes: int, features: int) -> np.ndarray:
    """One row for each class: a weight for each feature and the constant."""
    return np.zeros((classes, features + 1))


def logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Feature by feature, so a row's result does not depend on the rows beside it."""
    out = np.repeat(weights[None, :, -1], len(x), axis=0)
    for j in range(x.shape[1]):
        out += x[:, j:j + 1] * weights[:, j]
    return out


def probabilities(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class probabilities, logits and the logarithm of their normaliser."""
    z = logits(x, weights)
    top = z.max(axis=1)
    e = np.exp(z - top[:, None])
    total = e[:, 0].copy()
    for c in range(1, e.shape[1]):
        total += e[:, c]
    return e / total[:, None], z, top + np.log(total)


def usable(features: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have ``width`` finite features within the limit, and which rows these are."""
    right = pc.fill_null(pc.equal(pc.list_value_length(features), width), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = features.take(pa.array(rows)).flatten()
    x = np.array(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    good = (np.abs(x) <= LIMIT).all(axis=1)
    return x[good], rows[good]


def halves(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of whole units, in two parts that do not overflow."""
    return (units >> HALF_BITS).sum(axis=0), (units & ((1 << HALF_BITS) - 1)).sum(axis=0)


def whole(values: np.ndarray) -> np.ndarray:
    return np.rint(values * UNIT).astype(np.int64)


def measure(df: DataFrame, features: str, label: str, weights: np.ndarray) -> Step:
    """Loss and gradient of weights over all rows, in one pass."""
    classes, width = weights.shape[0], weights.shape[1] - 1

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((classes, width + 1), np.int64), np.zeros((classes, width + 1), np.int64)
        n = n_bad = loss_high = loss_low = 0
        for batch in batches:
            x, rows = usable(batch.column("x"), width)
            y = batch.column("y").fill_null(-1).to_numpy(zero_copy_only=False)[rows]
            known = (y >= 0) & (y < classes)
            x, y = x[known], y[known]
            n, n_bad = n + len(y), n_bad + len(batch) - len(y)
            for at in range(0, len(y), CHUNK):
                part, of = x[at:at + CHUNK], y[at:at + CHUNK]
                p, z, normaliser = probabilities(part, weights)
                lines = np.arange(len(of))
                a, b = halves(whole(normaliser - z[lines, of]))
                loss_high, loss_low = loss_high + int(a), loss_low + int(b)
                p[lines, of] -= 1
                for c in range(classes):
                    a, b = halves(whole(np.concatenate([p[:, c:c + 1] * part, p[:, c:c + 1]], axis=1)))
                    high[c] += a
                    low[c] += b
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(classes), pa.int32()), pa.array(high.tolist(), pa.list_(pa.int64())), pa.array(low.tolist(), pa.list_(pa.int64())),
            *[pa.array([v] + [0] * (classes - 1), pa.int64()) for v in (n, n_bad, loss_high, loss_low)]],
            names=["cls", "high", "low", "n", "n_bad", "loss_high", "loss_low"])

    inputs = df.select(F.col(features).alias("x"), F.col(label).try_cast("bigint").alias("y"))
    shares = inputs.mapInArrow(share, "cls int, high array<bigint>, low array<bigint>, n bigint, n_bad bigint, loss_high bigint, loss_low bigint")
    totals = [F.sum(F.when(F.col("pos") == 0, F.col(c)).cast("decimal(38,0)")).alias(c) for c in ("n", "n_bad", "loss_high", "loss_low")]
    cells = shares.select("cls", F.posexplode(F.arrays_zip("high", "low")).alias("pos", "s"), "n", "n_bad", "loss_high", "loss_low")
    sums = cells.groupBy("cls", "pos").agg(F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"), *totals).collect()
    gradient = np.zeros_like(weights)
    counts = {c: sum(int(r[c] or 0) for r in sums) for c in ("n", "n_bad", "loss_high", "loss_low")}
    n = counts["n"]
    for r in sums if n else ():
        gradient[r["cls"], r["pos"]] = ((int(r["high"]) << HALF_BITS) + int(r["low"])) / (UNIT * n)
    loss = ((counts["loss_high"] << HALF_BITS) + counts["loss_low"]) / (UNIT * n) if n else float("nan")
    return Step(loss, gradient, norm_of(gradient), n, counts["n_bad"])


def norm_of(values: np.ndarray) -> float:
    """Square root of the sum of squares, added in order."""
    total = 0.0
    for v in values.reshape(-1).tolist():
        total += v * v
    return total ** 0.5


def fit_softmax(df: DataFrame, features: str, label: str, classes: int, width: int, steps: int, rate: float, start: np.ndarray | None = None,
                clip: float | None = None) -> tuple[np.ndarray, list[Step]]:
    """Weights after full-batch gradient steps, and what was measured before each step and at the end.

    ``start`` continues from given weights. A gradient longer than ``clip`` is scaled down to that length.
    """
    weights = zero_weights(classes, width) if start is None else start.copy()
    found = []
    for _ in range(steps):
        found.append(measure(df, features, label, weights))
        scale = 1.0 if clip is None or found[-1].norm <= clip else clip / found[-1].norm
        weights = weights - rate * scale * found[-1].gradient
    return weights, [*found, measure(df, features, label, weights)]


def score_softmax(df: DataFrame, features: str, weights: np.ndarray) -> DataFrame:
    """Adds ``prediction``, the most probable class (ties: the smaller one), and its probability ``p``; both null for a bad row."""
    shipped = df.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in df.columns if c not in ("prediction", "p")]
    inputs = df.select(*rest, F.col(features).alias("__x"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = usable(batch.column("__x"), shipped.value.shape[1] - 1)
            best, chance = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            missing = np.ones(len(batch), bool)
            missing[rows] = False
            if len(rows):
                p = probabilities(x, shipped.value)[0]
                best[rows] = p.argmax(axis=1)
                chance[rows] = p[np.arange(len(rows)), best[rows]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, mask=missing), pa.array(chance, mask=missing)],
                                             names=[*batch.schema.names[:-1], "prediction", "p"])

    schema = inputs.drop("__x").withColumns({"prediction": F.lit(None).cast("int"), "p": F.lit(None).cast("double")}).schema
    return inputs.mapInArrow(score, schema)


def weights_table(spark: SparkSession, weights: np.ndarray, last: Step) -> DataFrame:
    """A row for each class, ready to be stored as a version."""
    rows = [(c, w, last.loss, last.norm, last.n, last.n_bad) for c, w in enumerate(weights.tolist())]
    return spark.createDataFrame(rows, STATE)


def weights_of(table: DataFrame) -> np.ndarray:
    return np.array([r["weights"] for r in table.orderBy("cls").select("weights").collect()])


def model_update(features: str, label: str, classes: int, width: int, steps: int, rate: float,
                 clip: float | None = None) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """An update for ``streaming.guarded``: some clipped steps on a micro-batch from the weights committed last."""
    def update(current: DataFrame | None, batch: DataFrame) -> DataFrame:
        start = None if current is None else weights_of(current)
        weights, found = fit_softmax(batch, features, label, classes, width, steps, rate, start, clip)
        return weights_table(batch.sparkSession, weights, found[-1])

    return update


def model_gate(longest: float, highest_loss: float = float("inf")) -> dict[str, Column]:
    """Finite weights and loss, no bad rows, and weights and loss within bounds."""
    square = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)
    finite = F.forall("weights", lambda w: (F.abs(w) < float("inf")) & ~F.isnan(w)) & ~F.isnan("loss") & (F.abs(F.col("loss")) < float("inf"))
    return {"finite": F.bool_and(finite), "no_bad_rows": F.max("n_bad") == 0, "weights_bounded": F.sqrt(F.sum(square)) <= longest,
            "loss_bounded": F.max("loss") <= highest_loss}
