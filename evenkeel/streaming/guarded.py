"""Updates that are kept only when they pass a gate."""

from __future__ import annotations

import logging
from typing import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fingerprint import table_fingerprint
from ..sources.files import exists
from ..sources.snapshots import commit, committed, latest_version, load_snapshot, read_manifest, stage_tables, staged_path
from .sinks import _triggered

LOG = logging.getLogger(__name__)
STATE = "state"

# Spark's conditions that blame the data. All else, as a lost disk or executor, fails the batch, which is retried.
DATA_ERRORS = ("USER_RAISED_EXCEPTION", "ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "NUMERIC_VALUE_OUT_OF_RANGE", "CAST_INVALID_INPUT",
               "CAST_OVERFLOW", "INVALID_ARRAY_INDEX", "DATETIME_OVERFLOW")


def blames_data(error: Exception) -> bool:
    return not isinstance(error, PySparkException) or any(f"[{name}" in str(error) for name in DATA_ERRORS)

Update = Callable[[DataFrame | None, DataFrame], DataFrame]


def guarded_update(stream: DataFrame, root: str, update: Update, gate: Mapping[str, Column], checkpoint: str,
                   loss: Column | None = None, norm: Column | None = None, mode: str = "light",
                   scale: int | None = None, interval: str | None = None) -> StreamingQuery:
    """Per micro-batch: build a candidate state, check it, commit it or keep the old one.

    ``update`` gets the newest state committed below this batch (None at first) and the batch.
    ``gate`` names boolean aggregates over the candidate; all must be true. The candidate is written
    once, checked from there, and committed by its manifest, so a rejected one is never visible. A batch whose version
    is committed is skipped when it comes again, but for its status row if that is missing; a rejected one is tried again from the
    same state with the same result. What a stopped attempt has written is never read.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = committed(spark, root, batch_id)
        if done and exists(spark, f"{_status_path(root, batch_id)}/_SUCCESS"):
            return
        base = read_manifest(spark, root, batch_id).base if done else latest_version(spark, root, below=batch_id)
        current = None if base is None else load_snapshot(spark, root, base)[STATE]
        reasons, figures, changed = [], (None, None), None
        try:
            if done:
                candidate = load_snapshot(spark, root, batch_id)[STATE]
            else:
                attempt = stage_tables({STATE: update(current, batch)}, root, batch_id, mode)
                candidate = spark.read.parquet(staged_path(root, batch_id, attempt, STATE))
            checks = candidate.agg(*[F.coalesce(ok, F.lit(False)).alias(name) for name, ok in gate.items()],
                                   _figure(loss, "__loss"), _figure(norm, "__norm")).first()
            figures = (checks["__loss"], checks["__norm"])
            reasons = [name for name in gate if not checks[name]]
            changed = current is None or _hash(candidate, scale) != _hash(current, scale)
        except (PySparkException, ValueError, ArithmeticError) as error:
            if done or not blames_data(error):
                raise
            LOG.warning("batch %s rejected: %s", batch_id, error)
            reasons = [type(error).__name__]
        if not reasons and not done:
            commit(spark, root, batch_id, attempt, [STATE], mode, scale=scale, base=base)
        _report(spark, root, batch_id, base, not reasons, ",".join(reasons) or None, figures, changed)

    return _triggered(stream.writeStream.foreachBatch(run), checkpoint, interval).start()


def _figure(value: Column | None, name: str) -> Column:
    return (F.lit(None) if value is None else value).cast("double").alias(name)


def _hash(df: DataFrame, scale: int | None):
    row = table_fingerprint(df, scale=scale).first()
    return row["n_rows"], row["hash_sum"]


def _report(spark: SparkSession, root: str, batch_id: int, base, accepted: bool, reason, figures, changed) -> None:
    schema = "accepted boolean, reason string, base bigint, loss double, norm double, changed boolean"
    row = (accepted, reason, base, figures[0] if accepted else float("nan"), figures[1], changed)
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(_status_path(root, batch_id))


def _status_path(root: str, batch_id: int) -> str:
    return f"{root}/status/batch_id={batch_id}"


def update_status(spark: SparkSession, root: str) -> DataFrame:
    """One row per micro-batch: accepted or not, why, from which base, loss (NaN if rejected), norm."""
    return spark.read.parquet(f"{root}/status").withColumn("batch_id", F.col("batch_id").cast("bigint"))
