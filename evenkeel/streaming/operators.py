"""Promotion, monitoring and state folds over streams."""

from __future__ import annotations

from decimal import Decimal
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.accumulators import all_finite, bad_count, exact_sum, fit_count, stable_mean, stable_variance
from ..operators.heat import as_list
from ..operators.sampling import promote
from ..sources.artifacts import TIME_FORMATS

UNIT = 1_000_000


def stream_promote(stream: DataFrame, key, p: float = 0.05, where: Column | None = None, seed: int = 0,
                   domain: str = "promote") -> DataFrame:
    """Stateless promotion: the same rows as in batch, however the stream is cut."""
    return promote(stream, key, p, where, seed, domain)


def stream_monitor(stream: DataFrame, by, value: str) -> DataFrame:
    """Live count, exact sum, mean, variance and finiteness per group, for ``update`` mode.

    All of it comes from exact sums, so the cut into micro-batches makes no difference.
    """
    v = F.col(value)
    return stream.groupBy(*as_list(by)).agg(
        fit_count(v).alias("n"), bad_count(v).alias("n_bad"), exact_sum(v).alias("sum"),
        stable_mean(v).alias("mean"), stable_variance(v).alias("var"), all_finite(v).alias("all_finite"))


# Stands for a missing time, and for a missing id.
NEVER, NO_ID = -(1 << 62), -(1 << 63) + 1
# Keys are dealt into so many groups of the stream: what Spark does for each group of a micro-batch costs far more than a key's few rows.
BUCKETS = 1024
# Whole numbers of one key: units, time and id of the last row, steps, late rows.
HELD = 5

_STATE = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("held", T.BinaryType())])


def stream_fold(stream: DataFrame, key: str, ts: str, row_id: str, delta: str, lo: float, hi: float,
                init: float, buckets: int = BUCKETS) -> DataFrame:
    """Running ``state = min(hi, max(lo, state + delta))`` per key; one row per key and micro-batch.

    Rows of a micro-batch are applied in (ts, row_id) order. Rows not after the last one applied, and rows without a time, are
    counted as ``n_late`` and left out; a row without an id comes before the others of its time. Amounts are whole millionths, so the
    state equals the batch fold's. The stream is grouped by ``buckets`` hashes of the key, each with the state of all its keys. The rows
    of one bucket within one micro-batch meet in one task: bound them with the source's ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger``, or with more buckets. A checkpoint belongs to its number of buckets.
    """
    low, high, start = (round(x * UNIT) for x in (lo, hi, init))
    # No amount moves the state farther than this, so larger ones are cut to it and every number fits.
    reach = F.lit(Decimal(high - low + abs(start - low) + abs(start - high)) / UNIT).cast(T.DecimalType(38, 6))
    # least and greatest pass over NULL, so an amount that is missing is made 0 first.
    given = F.coalesce(F.col(delta).try_cast(T.DecimalType(38, 6)), F.lit(0).cast(T.DecimalType(38, 6)))
    amount = (F.least(reach, F.greatest(-reach, given)).cast(T.DecimalType(24, 6)) * F.lit(UNIT)).cast("bigint")
    key_field = stream.schema[key]
    # A key's text as JSON: it reads back as the key, of any type, and NULL differs from all values.
    slim = stream.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket"), F.to_json(F.struct(key), TIME_FORMATS).alias("__key"),
                         F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NEVER)).alias("__ts"),
                         F.coalesce(F.col(row_id).cast("bigint"), F.lit(NO_ID)).alias("__id"), amount.alias("__d"))
    out = T.StructType([T.StructField("__key", T.StringType()), T.StructField("state", T.DoubleType()),
                        T.StructField("n_steps", T.LongType()), T.StructField("n_late", T.LongType())])

    def step(group: tuple, chunks: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        names, numbers = memory.get if memory.exists else ([], b"")
        held = dict(zip(names, np.frombuffer(numbers, np.int64).reshape(-1, HELD).tolist()))
        rows = pd.concat(list(chunks))
        codes, present = pd.factorize(rows["__key"])
        order = np.lexsort((rows["__id"], rows["__ts"], codes))
        times, ids, steps = (rows[c].to_numpy()[order].tolist() for c in ("__ts", "__id", "__d"))
        ends = np.cumsum(np.bincount(codes, minlength=len(present))).tolist()
        for name, begin, end in zip(present, [0, *ends], ends):
            units, last_ts, last_id, n, late = held.get(name, (start, NEVER, -NO_ID, 0, 0))
            for t, i, d in zip(times[begin:end], ids[begin:end], steps[begin:end]):
                if (t, i) <= (last_ts, last_id):
                    late += 1
                    continue
                units, last_ts, last_id, n = min(high, max(low, units + d)), t, i, n + 1
            held[name] = units, last_ts, last_id, n, late
        memory.update((list(held), np.array(list(held.values()), np.int64).tobytes()))
        now = np.array([held[name] for name in present], np.int64)
        yield pd.DataFrame({"__key": present, "state": now[:, 0] / UNIT, "n_steps": now[:, 3], "n_late": now[:, 4]})

    folded = slim.groupBy("__bucket").applyInPandasWithState(step, out, _STATE, "update", GroupStateTimeout.NoTimeout)
    read_back = F.from_json("__key", T.StructType([key_field]), TIME_FORMATS)[key]
    return folded.select(read_back.alias(key), "state", "n_steps", "n_late")
