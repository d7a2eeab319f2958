"""Session settings and the shared folder used for checkpoints and work tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_CONF = "spark.evenkeel.hotKeyRows"
BLOCK_ROWS_CONF = "spark.evenkeel.blockRows"

# A key with more rows than this is spread over several tasks.
DEFAULT_HOT_ROWS = 4_000_000
# Upper limit on the rows of one key that are ever gathered into one array.
DEFAULT_BLOCK_ROWS = 8_192

STATE_CONF = "spark.sql.streaming.stateStore.providerClass"
STATE_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "evenkeel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; AQE and ANSI stay on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # State of streams lies on disk and not in the executors' heap.
        STATE_CONF: STATE_ON_DISK,
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started in this block keep their state in RocksDB, whatever the session was built with.

    A stream takes the settings of its session when it starts; the session's own setting comes back after the block.
    """
    given = spark.conf.get(STATE_CONF, None)
    spark.conf.set(STATE_CONF, STATE_ON_DISK)
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(STATE_CONF)
        else:
            spark.conf.set(STATE_CONF, given)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new path for one run below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read the stored rows, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
