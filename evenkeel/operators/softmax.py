"""Grouped softmax over scores held one per row.

Each group needs three totals in turn: the largest score, the sum of shifted exponentials, and the
sum of floored probabilities. Groups that fit a task take them from one window (one shuffle). Hot
groups take them from map-side aggregates that are broadcast back (one row per hot group), so their
rows are never moved. Exponentials are summed as decimals, so both ways agree.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import (ARGMAX_TEMPERATURE, MIN_TEMPERATURE, PROBABILITY_FLOOR, SCORE_LIMIT, SENTINEL, clamp,
                                 replace_nonfinite)
from .heat import as_list, attach, by_heat

_TERM = T.DecimalType(28, 18)


def _exact(x: Column) -> Column:
    return x.cast(_TERM)


def stable_softmax(df: DataFrame, group, key, score: str, temp: Column | float = 1.0, name: str = "p",
                   hot_rows: int | None = None) -> DataFrame:
    """Probability of each row within its group.

    ``key`` orders the rows of a group: below a temperature of 1e-8 the first row with the largest
    score gets 1 and the others 0. ``temp`` may be a column that is constant within a group. NULL and
    NaN scores count as the low sentinel.
    """
    group, key = as_list(group), as_list(key)
    t = temp if isinstance(temp, Column) else F.lit(float(temp))
    t = F.greatest(F.lit(MIN_TEMPERATURE), t.cast("double"))
    raw = F.coalesce(replace_nonfinite(F.col(score).cast("double")), F.lit(-SENTINEL))
    base = df.withColumns({"__t": t, "__raw": raw}).withColumn(
        "__x", clamp(F.col("__raw") / F.col("__t"), -SCORE_LIMIT, SCORE_LIMIT))
    may_be_cold = isinstance(temp, Column) or temp < ARGMAX_TEMPERATURE

    shifted = F.exp(F.col("__x") - F.col("__top"))
    floored = F.greatest(F.lit(PROBABILITY_FLOOR), shifted / F.col("__s").cast("double"))
    p = F.col("__f") / F.col("__z").cast("double")
    if may_be_cold:
        one_hot = F.when(F.struct(*key).eqNullSafe(F.col("__best")), 1.0).otherwise(0.0)
        p = F.when(F.col("__t") < ARGMAX_TEMPERATURE, one_hot).otherwise(p)
    scratch = ["__t", "__raw", "__x", "__top", "__most", "__best", "__s", "__f", "__z"]

    w = Window.partitionBy(*group)

    def cold(rows):
        if may_be_cold:
            ranked = w.orderBy(F.col("__raw").desc(), *key)
            rows = rows.withColumn("__best", F.first(F.struct(*key)).over(ranked))
        return (rows.withColumn("__top", F.max("__x").over(w))
                .withColumn("__s", F.sum(_exact(shifted)).over(w))
                .withColumn("__f", floored)
                .withColumn("__z", F.sum(_exact(F.col("__f"))).over(w))
                .withColumn(name, p).drop(*scratch))

    def hot(rows):
        rows = attach(rows, rows.groupBy(*group).agg(F.max("__x").alias("__top"), F.max("__raw").alias("__most")), group)
        if may_be_cold:
            at_top = F.when(F.col("__raw") == F.col("__most"), F.struct(*key))
            rows = attach(rows, rows.groupBy(*group).agg(F.min(at_top).alias("__best")), group)
        rows = attach(rows, rows.groupBy(*group).agg(F.sum(_exact(shifted)).alias("__s")), group)
        rows = rows.withColumn("__f", floored)
        rows = attach(rows, rows.groupBy(*group).agg(F.sum(_exact(F.col("__f"))).alias("__z")), group)
        return rows.withColumn(name, p).drop(*scratch)

    return by_heat(base, group, hot_rows, cold, hot)


def softmax_sweep(df: DataFrame, group, score: str, scales: Sequence[float],
                  hot_rows: int | None = None) -> DataFrame:
    """L1 distance per scale between the guarded softmax and the plain one, and their maximum.

    The plain form, exp(x - max) over its sum without a floor, comes from the same windows as the
    guarded one, so ordinary groups move once.
    """
    group = as_list(group)
    scaled = (df.select(*group, F.col(score).cast("double").alias("__score"))
              .withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
              .withColumn("__x", clamp(F.coalesce(replace_nonfinite(F.col("__score") * F.col("scale")), F.lit(-SENTINEL)), -SCORE_LIMIT, SCORE_LIMIT)))
    keys = ["scale", *group]
    shifted = F.exp(F.col("__x") - F.col("__top"))
    plain = shifted / F.col("__s").cast("double")
    floored = F.greatest(F.lit(PROBABILITY_FLOOR), plain)
    gap = F.abs(F.col("__f") / F.col("__z").cast("double") - F.col("__p"))
    w = Window.partitionBy(*keys)

    def cold(rows):
        return (rows.withColumn("__top", F.max("__x").over(w)).withColumn("__s", F.sum(_exact(shifted)).over(w))
                .withColumns({"__p": plain, "__f": floored}).withColumn("__z", F.sum(_exact(F.col("__f"))).over(w)))

    def hot(rows):
        rows = attach(rows, rows.groupBy(*keys).agg(F.max("__x").alias("__top")), keys)
        rows = attach(rows, rows.groupBy(*keys).agg(F.sum(_exact(shifted)).alias("__s")), keys)
        rows = rows.withColumns({"__p": plain, "__f": floored})
        return attach(rows, rows.groupBy(*keys).agg(F.sum(_exact(F.col("__f"))).alias("__z")), keys)

    distances = by_heat(scaled, keys, hot_rows, cold, hot).groupBy(*keys).agg(F.sum(_exact(gap)).cast("double").alias("l1"))
    return distances.groupBy("scale").agg(F.max("l1").alias("max_l1"), F.count(F.lit(1)).alias("n_groups"))
