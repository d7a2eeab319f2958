"""Batch-wise sinks that may be replayed: every micro-batch owns one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.heat import as_list
from ..sources.artifacts import TIME_FORMATS
from ..sources.files import names_in
from ..sources.snapshots import append_snapshot, latest_version


def _triggered(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> DataStreamWriter:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def sink_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                 interval: str | None = None) -> StreamingQuery:
    """Write each micro-batch to ``path/batch_id=N``; a replay writes the same directory again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _triggered(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, interval).start()


def latest_rows(spark: SparkSession, path: str, key) -> DataFrame:
    """The newest row of each key from a table written in update mode."""
    key = as_list(key)
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*key, "batch_id")]
    newest = F.max_by(F.struct(*others), F.col("batch_id").cast("bigint")).alias("__row")
    return rows.groupBy(*key).agg(newest).select(*key, "__row.*")


def stream_trace_sink(stream: DataFrame, path: str, checkpoint: str, n: int = 512,
                      interval: str | None = None) -> StreamingQuery:
    """Append trace records as JSON below ``seed=...`` in files of at most ``n`` records, exactly once."""
    writer = (stream.writeStream.outputMode("append").format("json").partitionBy("seed")
              .options(path=path, maxRecordsPerFile=n, **TIME_FORMATS))
    return _triggered(writer, checkpoint, interval).start()


def periodic_snapshot(stream: DataFrame, path: str, root: str, checkpoint: str, every: int = 10, mode: str = "light",
                      scale: int | None = None, interval: str | None = None) -> StreamingQuery:
    """Append each micro-batch below ``path``; every n-th one also commits a snapshot of all rows so far.

    A snapshot adds the rows since the last one to its parts, so what is written follows the new rows. A version that is committed is
    skipped when its batch comes again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            _append_since(batch.sparkSession, path, root, batch_id, mode, scale)

    return _triggered(stream.writeStream.outputMode("append").foreachBatch(write), checkpoint, interval).start()


def _append_since(spark: SparkSession, path: str, root: str, batch_id: int, mode: str, scale: int | None) -> None:
    newest = latest_version(spark, root, below=batch_id)
    number = F.col("batch_id").cast("bigint")
    fresh = spark.read.parquet(path).withColumn("batch_id", number).filter((number <= batch_id) & (number > (-1 if newest is None else newest)))
    append_snapshot({"rows": fresh}, root, batch_id, mode, scale=scale, if_committed="skip")


def snapshot_rest(spark: SparkSession, path: str, root: str, mode: str = "light", scale: int | None = None) -> int | None:
    """Commit what ``periodic_snapshot`` wrote since its last snapshot; returns the newest version."""
    batches = [int(name[9:]) for name in names_in(spark, path) if name.startswith("batch_id=")]
    newest = latest_version(spark, root)
    if batches and (newest is None or newest < max(batches)):
        _append_since(spark, path, root, max(batches), mode, scale)
        return max(batches)
    return newest
