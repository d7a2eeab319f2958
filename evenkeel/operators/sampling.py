"""Sampling whose result depends on the data and the seed only."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import bernoulli, uniform, uniform_int
from ..functions.scalars import is_finite
from .heat import ALL_COLD, ALL_HOT, as_list, attach, by_heat, same_keys
from .ordered import number_rows, running


def promote(df: DataFrame, key, p: float | Column = 0.05, where: Column | None = None, seed: int = 0,
            domain: str = "promote") -> DataFrame:
    """Keep each row with probability ``p``, drawn from its key; works on streams as well."""
    kept = df if where is None else df.filter(where)
    return kept.filter(bernoulli(p, seed, domain, *as_list(key)))


def _run_and_total(df: DataFrame, group, key, weight: str, hot_rows: int | None,
                   finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exact running and total weight of each group as parts of its largest weight, then ``finish``.

    Dividing by the largest weight first keeps the same number of digits for weights of any size.
    Ordinary groups take all of it from windows over the same rows (one shuffle); the totals of hot
    groups are broadcast back.
    """
    w, top = F.col(weight).cast("double"), F.col("__top")
    part = F.when(is_finite(w) & is_finite(top) & (top > 0), w / top).cast("decimal(28,18)")
    run = {"__run": ("sum", part)}

    def cold(rows):
        whole = Window.partitionBy(*group)
        summed = running(rows.withColumn("__top", F.max(w).over(whole)), group, key, run, ALL_COLD)
        return finish(summed.withColumn("__total", F.sum(part).over(whole)))

    def hot(rows):
        rows = attach(rows, rows.groupBy(*group).agg(F.max(w).alias("__top")), group)
        totals = rows.groupBy(*group).agg(F.sum(part).alias("__total"))
        return finish(attach(running(rows, group, key, run, ALL_HOT), totals, group))

    return by_heat(df, group, hot_rows, cold, hot)


def _share() -> Column:
    return F.try_divide(F.col("__run").cast("double"), F.col("__total").cast("double"))


def running_cdf(df: DataFrame, group, key, weight: str, name: str = "cdf",
                hot_rows: int | None = None) -> DataFrame:
    """Running share of the group's total weight, in key order, from exact sums."""
    return _run_and_total(df, as_list(group), as_list(key), weight, hot_rows,
                          lambda rows: rows.withColumn(name, _share()).drop("__run", "__total", "__top"))


def sample_categorical(df: DataFrame, group, key, weight: str, seed: int = 0, domain: str = "policy",
                       hot_rows: int | None = None) -> DataFrame:
    """One row per group: a key drawn with probability proportional to its weight.

    The drawn key is the first whose running share exceeds the draw, or the last with a positive
    weight if rounding leaves none. A total that is not finite or not positive gives the key with
    the largest weight, NaN counting as largest. Weights must not be negative.
    """
    group, key = as_list(group), as_list(key)
    slim = df.select(*dict.fromkeys([*group, *key, weight]))
    pick = F.struct(*key)
    w = F.col(weight)
    largest_first = F.struct((~F.isnan(w.cast("double"))).alias("nan_first"), (-w.cast("double")).alias("w"), *key)

    def finish(rows):
        drawn = rows.withColumn("__u", uniform(seed, domain, *group)).groupBy(*group).agg(
            F.min(F.when(F.col("__u") < _share(), pick)).alias("__hit"),
            F.max(F.when(w > 0, pick)).alias("__last"),
            F.min_by(pick, largest_first).alias("__best"),
            (F.coalesce(F.bool_and(F.when(w.isNotNull(), is_finite(w))), F.lit(False))
             & (F.coalesce(F.max("__total"), F.lit(0)) > 0)).alias("__usable"))
        chosen = F.when(F.col("__usable"), F.coalesce("__hit", "__last")).otherwise(F.col("__best"))
        return drawn.withColumn("__chosen", chosen).select(*group, *[F.col(f"__chosen.{k}").alias(k) for k in key])

    return _run_and_total(slim, group, key, weight, hot_rows, finish)


def argmax_by(df: DataFrame, group, key, value: str) -> DataFrame:
    """Per group the row with the largest value, the lowest key on ties; NULL and NaN are lowest."""
    group, key = as_list(group), as_list(key)
    v = F.col(value).cast("double")
    best = F.min_by(F.struct(*key, value), F.struct(F.coalesce(F.isnan(v), F.lit(True)).alias("last"), (-v).alias("v"), *key))
    return df.groupBy(*group).agg(best.alias("__best")).select(*group, "__best.*")


def minibatch(df: DataFrame, key, order_by, n: int = 32, seed: int = 0, domain: str = "train",
              hot_rows: int | None = None) -> DataFrame:
    """``n`` draws with replacement from the rows of each key that has at least ``n`` rows.

    Draws are positions. All draws of a key lie in one array, which joins the numbered rows by key and so keeps
    their partitioning: the rows themselves move once.
    """
    key = as_list(key)
    numbered = number_rows(df, key, order_by, "__pos", hot_rows=hot_rows).withColumn("__pos", F.col("__pos") - 1)
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: F.struct(
        d.alias("draw"), uniform_int(0, F.col("__n"), seed, domain, *key, d).alias("at")))
    draws = sizes.select(*key, drawn.alias("__draws"))
    joined = numbered.alias("b").join(draws.alias("d"), same_keys("b", "d", key)).select("b.*", "d.__draws")
    mine = F.filter("__draws", lambda x: x["at"] == F.col("__pos"))
    return (joined.withColumn("__hit", F.explode(mine)).withColumn("draw", F.col("__hit.draw"))
            .drop("__draws", "__hit").withColumnRenamed("__pos", "position"))
