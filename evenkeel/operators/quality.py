"""Checks that prove the properties the other operators promise."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fingerprint import table_fingerprint

# Keys every metrics record must have.
METRIC_KEYS = ("duration_s", "depth", "encounters", "hp_mean", "xp_mean", "timestamp", "seed")


def missing_columns(df: DataFrame, names: Sequence[str] = METRIC_KEYS) -> list[str]:
    """Required columns the schema lacks; looks at no data."""
    return [n for n in names if n not in df.columns]


def require_columns(df: DataFrame, names: Sequence[str] = METRIC_KEYS) -> DataFrame:
    lost = missing_columns(df, names)
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def missing_keys(df: DataFrame, json_col: str, required: Sequence[str] = METRIC_KEYS,
                 name: str = "missing") -> DataFrame:
    """Required keys each JSON text lacks; a text that is not a JSON object lacks all of them."""
    wanted = F.array(*[F.lit(r) for r in required])
    found = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    return df.withColumn(name, F.array_except(wanted, found))


def _as_rows(totals: DataFrame, labels: Sequence[str], items: Mapping[str, Column]) -> DataFrame:
    """Turn one wide row of counts into one row per labelled count."""
    return totals.select(F.explode(F.array(*items.values())).alias("__r")).select(
        *[F.col(f"__r.{c}").alias(c) for c in labels])


def invariant_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """For each rule the rows that break it (NULL counts as broken), all in one pass."""
    names = list(rules)
    totals = df.agg(*[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(f"__{i}") for i, n in enumerate(names)])
    items = {n: F.struct(F.lit(n).alias("rule"), F.col(f"__{i}").alias("n_bad"), (F.col(f"__{i}") == 0).alias("ok"))
             for i, n in enumerate(names)}
    return _as_rows(totals, ["rule", "n_bad", "ok"], items)


def leak_scan(df: DataFrame, patterns: Sequence[str], literals: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of each text column in which a pattern occurs, all in one pass over whole texts.

    ``literals`` may name, for a pattern, a text that every match contains; where it is missing the
    pattern is not tried.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    pairs = [(c, p) for c in texts for p in patterns]
    if not pairs:
        raise ValueError("no text column or no pattern to look for")
    needed = literals or {}

    def found(column: str, pattern: str) -> Column:
        hit = F.col(column).rlike(pattern)
        return F.contains(F.col(column), F.lit(needed[pattern])) & hit if pattern in needed else hit

    totals = df.agg(*[F.count_if(F.coalesce(found(c, p), F.lit(False))).alias(f"__{i}") for i, (c, p) in enumerate(pairs)])
    items = {f"{i}": F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("pattern"), F.col(f"__{i}").alias("n_rows"),
                              (F.col(f"__{i}") == 0).alias("clean"))
             for i, (c, p) in enumerate(pairs)}
    return _as_rows(totals, ["column_name", "pattern", "n_rows", "clean"], items)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def determinism_audit(build: Callable[[DataFrame], DataFrame], df: DataFrame, layouts: Sequence[int],
                      scale: int | None = None) -> DataFrame:
    """Run an operator on several layouts of its input and compare the fingerprints of its results.

    Layout n deals the rows over n times ``spark.sql.shuffle.partitions`` tasks. One row per layout.
    """
    runs = [table_fingerprint(build(df.repartition(n * _tasks(df))), scale=scale).withColumn("layout", F.lit(n))
            for n in layouts]
    return _agree(reduce(DataFrame.unionByName, runs), "layout")


def order_invariance(df: DataFrame, scale: int | None = None) -> DataFrame:
    """Fingerprints of a table as it is, with its columns reversed, and with its rows dealt anew."""
    variants = {"as_is": df, "columns_reversed": df.select(*reversed(df.columns)), "rows_dealt": df.repartition(_tasks(df))}
    runs = [table_fingerprint(v, scale=scale).withColumn("variant", F.lit(n)) for n, v in variants.items()]
    return _agree(reduce(DataFrame.unionByName, runs), "variant")


def _agree(fingerprints: DataFrame, label: str) -> DataFrame:
    """One short row per run; ``same`` tells whether all runs gave the same fingerprint."""
    rows = F.collect_list(F.struct(label, "n_rows", "hash_sum"))
    return (fingerprints.agg(rows.alias("__rows"),
                             ((F.count_distinct("hash_sum") == 1) & (F.count_distinct("n_rows") == 1)
                              & (F.count_distinct("schema_hash") == 1)).alias("same"))
            .select(F.explode("__rows").alias("__r"), "same").select("__r.*", "same"))
