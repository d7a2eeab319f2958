"""Connected components of a graph given as pairs, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import work_path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour."""
    ways = _both_ways(pairs)
    low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return ways.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    moved = pairs.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(pairs: DataFrame) -> DataFrame:
    """(id, component) for every id of the pairs (a, b); the component is its smallest id.

    Both steps keep the components as they are and need only the smallest neighbour of a node, so no neighbourhood is
    ever gathered; the number of rounds grows with the logarithm of the longest path. Each round is stored.
    """
    now = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    before, state = None, _state(now)
    while state != before:
        now = stored(_small_star(_large_star(now)), "components")
        before, state = state, _state(now)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
