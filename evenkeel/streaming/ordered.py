"""A fold over a stream in the order of event times, with rows that may come late within a delay."""

from __future__ import annotations

from decimal import Decimal
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UNIT = 1_000_000

ROW = np.dtype([("ts", "<i8"), ("id", "<i8"), ("d", "<i8")])
MARK = np.dtype([("ts", "<i8"), ("id", "<i8")])
# Every so many rows of a run have a mark: the mark tells where a portion may end without reading the run.
MARK_EVERY = 256
# Rows that are put in order and folded at a time.
PORTION = 1 << 18
# Stands for a missing time.
NEVER = -(1 << 62)


def composed(steps: np.ndarray, low: int, high: int, reach: int) -> tuple[int, int, int]:
    """Clamp steps one after another as one step (d, lo, hi): s -> min(hi, max(lo, s + d)).

    Neighbours are composed pairwise until one is left, so an array of n steps takes log2(n) passes.
    """
    d = np.clip(steps, -reach, reach)
    lo, hi = np.full(len(d), low), np.full(len(d), high)
    while len(d) > 1:
        odd = len(d) % 2
        if odd:
            tail = d[-1:], lo[-1:], hi[-1:]
            d, lo, hi = d[:-1], lo[:-1], hi[:-1]
        d1, d2, l1, l2, h1, h2 = d[::2], d[1::2], lo[::2], lo[1::2], hi[::2], hi[1::2]
        # Past the reach every state ends at a bound, so longer ways need not be told apart.
        d, lo, hi = np.clip(d1 + d2, -reach, reach), np.clip(l1 + d2, l2, h2), np.clip(h1 + d2, l2, h2)
        if odd:
            d, lo, hi = (np.concatenate(x) for x in zip((d, lo, hi), tail))
    return int(d[0]), int(lo[0]), int(hi[0])


class OrderedFold(StatefulProcessor):
    """Keeps the rows of a key as sorted runs until the watermark has passed them, then folds them in order.

    State of a key: the fold, runs (``rows`` by number), and for each run how many rows it has, how many are folded, and
    its marks. A timer stands at the earliest row that waits.
    """

    def __init__(self, key: str, low: int, high: int, start: int, reach: int, portion: int) -> None:
        self.key, self.low, self.high, self.start, self.reach, self.portion = key, low, high, start, reach, portion

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "units bigint, n_steps bigint, n_late bigint, next_run bigint, n_waiting bigint, timer bigint")
        self.runs = handle.getMapState("runs", "run bigint", "rows binary")
        self.marks = handle.getMapState("marks", "run bigint", "n bigint, done bigint, marks binary")

    def _fold(self) -> list[int]:
        return list(self.fold.get()) if self.fold.exists() else [self.start, 0, 0, 0, 0, -1]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        border = passed(timerValues)
        state = self._fold()
        for chunk in rows:
            run = np.empty(len(chunk), ROW)
            for i, name in enumerate(ROW.names):  # by place: the worker renames columns with leading underscores
                run[name] = chunk.iloc[:, i - len(ROW.names)]
            waits = run[run["ts"] >= border]
            state[2] += len(run) - len(waits)
            if len(waits):
                waits = waits[np.lexsort((waits["id"], waits["ts"]))]
                self.runs.updateValue((state[3],), (waits.tobytes(),))
                marks = np.empty(-(-len(waits) // MARK_EVERY), MARK)
                marks["ts"], marks["id"] = waits["ts"][::MARK_EVERY], waits["id"][::MARK_EVERY]
                self.marks.updateValue((state[3],), (len(waits), 0, marks.tobytes()))
                state[3], state[4] = state[3] + 1, state[4] + len(waits)
        yield self._settle(key, state, border)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, self._fold(), passed(timerValues))

    def _settle(self, key, state: list[int], border: int) -> pd.DataFrame:
        """Fold all rows before the border, a portion at a time, and wait for the next one."""
        runs = {k[0]: [v[0], v[1], np.frombuffer(v[2], MARK)] for k, v in self.marks.iterator()}
        due = {k: v for k, v in runs.items() if int(v[2]["ts"][0]) < border}
        for end in portion_ends([marks[done // MARK_EVERY:] for _, done, marks in due.values()], border, self.portion):
            parts = []
            for number, entry in due.items():
                n, done, marks = entry
                # The mark at or before the next row of the run: a run that goes on behind the end is not read.
                if done < n and marks[done // MARK_EVERY].item() < end:
                    run = np.frombuffer(self.runs.getValue((number,))[0], ROW)
                    entry[1] = place_of(run, end)
                    parts.append(run[done:entry[1]])
            rows = np.concatenate(parts) if parts else np.empty(0, ROW)
            if len(rows):
                rows = rows[np.lexsort((rows["id"], rows["ts"]))]
                d, low, high = composed(rows["d"], self.low, self.high, self.reach)
                state[0] = min(high, max(low, state[0] + d))
                state[1], state[4] = state[1] + len(rows), state[4] - len(rows)
        for number, (n, done, marks) in due.items():
            if done == n:
                self.runs.removeKey((number,))
                self.marks.removeKey((number,))
                del runs[number]
            else:
                self.marks.updateValue((number,), (n, done, marks.tobytes()))
        self._wait(state, runs, border)
        self.fold.update(tuple(state))
        return pd.DataFrame({self.key: [key[0]], "state": [state[0] / UNIT], "n_steps": [state[1]], "n_late": [state[2]], "n_waiting": [state[4]]})

    def _wait(self, state: list[int], runs: dict, border: int) -> None:
        """One timer, at the first moment when a run may have a row before the watermark."""
        nexts = [max(border, int(marks["ts"][done // MARK_EVERY])) for _, done, marks in runs.values()]
        timer = min(nexts) // 1000 + 1 if nexts else -1
        if state[5] != timer:
            if state[5] >= 0:
                self.handle.deleteTimer(state[5])
            if timer >= 0:
                self.handle.registerTimer(timer)
            state[5] = timer

    def close(self) -> None:
        pass


def passed(timer_values) -> int:
    """Rows before this time, in microseconds, have been passed by the watermark; at first only those without a time."""
    mark = timer_values.getCurrentWatermarkInMs()
    return mark * 1000 if mark > 0 else NEVER + 1


def place_of(run: np.ndarray, end: tuple[int, int]) -> int:
    """How many rows of a sorted run are before (ts, id)."""
    a, b = np.searchsorted(run["ts"], end[0], "left"), np.searchsorted(run["ts"], end[0], "right")
    return int(a + np.searchsorted(run["id"][a:b], end[1], "left"))


def portion_ends(marks: list[np.ndarray], border: int, portion: int) -> list[tuple[int, int]]:
    """Ends (ts, id) that cut all rows before the border into portions of about so many rows and ``MARK_EVERY`` for each run at most."""
    last = (border, -(1 << 63))
    if not marks:
        return []
    whole = np.concatenate(marks)
    whole = whole[whole["ts"] < border]
    whole = whole[np.lexsort((whole["id"], whole["ts"]))]
    step = max(1, portion // MARK_EVERY)
    return [(int(m["ts"]), int(m["id"])) for m in whole[step::step]] + [last]


def ordered_stream_fold(stream: DataFrame, key: str, ts: str, row_id: str, delta: str, lo: float, hi: float, init: float,
                        delay: str, portion: int = PORTION) -> DataFrame:
    """Running ``state = min(hi, max(lo, state + delta))`` per key in (ts, row_id) order, for ``update`` mode.

    A row waits until the watermark (the greatest time so far less ``delay``) has passed it, so rows that come out of order within the
    delay are folded in their place. Rows before the watermark when they come are counted as ``n_late`` and left out;
    ``n_waiting`` rows are not folded yet. At most one row per key and micro-batch. Amounts are whole millionths, so the
    state equals the batch fold's over the rows that are not late.

    Rows are taken from Spark's batches one at a time and kept on disk as sorted runs; what is in memory at once is a batch or a portion
    (``portion`` rows and the marks), however many rows a key has. The state store must be RocksDB:
    start the stream within ``session.state_on_disk``, or in a session of ``build_session``. A row
    without time counts as late; without amount it moves nothing; without id it comes before the others of its time.
    """
    low, high, start = (round(x * UNIT) for x in (lo, hi, init))
    reach = high - low + abs(start - low) + abs(start - high)
    cut = F.lit(Decimal(reach) / UNIT).cast(T.DecimalType(38, 6))
    # least and greatest pass over NULL, so an amount that is missing is made 0 first.
    given = F.coalesce(F.col(delta).try_cast(T.DecimalType(38, 6)), F.lit(0).cast(T.DecimalType(38, 6)))
    amount = (F.least(cut, F.greatest(-cut, given)).cast(T.DecimalType(24, 6)) * F.lit(UNIT)).cast("bigint")
    marked = stream.withColumn("__time", F.col(ts).cast("timestamp")).withWatermark("__time", delay)
    # The time goes on as a number: Spark would drop late rows of a watermarked column before they could be counted.
    slim = marked.select(key, F.coalesce(F.unix_micros("__time"), F.lit(NEVER)).alias("__ts"),
                         F.coalesce(F.col(row_id).cast("bigint"), F.lit(-(1 << 63) + 1)).alias("__id"), amount.alias("__d"))
    out = T.StructType([stream.schema[key], T.StructField("state", T.DoubleType()), T.StructField("n_steps", T.LongType()),
                        T.StructField("n_late", T.LongType()), T.StructField("n_waiting", T.LongType())])
    return slim.groupBy(key).transformWithStateInPandas(OrderedFold(key, low, high, start, reach, portion), outputStructType=out, outputMode="Update", timeMode="EventTime")
