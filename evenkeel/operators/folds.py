"""State folded over the rows of a key in order.

Rows are cut into blocks by position. A block of "add, then keep within bounds" steps is itself one
such step, so blocks are reduced in parallel and then chained. Amounts are decimals, so the cut
makes no difference to the result.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import quantize
from ..functions.scalars import XP_LIMIT, recover
from ..session import block_rows as session_block_rows
from .heat import ALL_COLD, ALL_HOT, as_list, by_heat, same_keys
from .ordered import number_rows, running, spread, windowed

SCALE = 6
AMOUNT = T.DecimalType(38, SCALE)
_PART = T.DecimalType(36, SCALE)

# Fixed values of the levelling rule.
START_HP, START_LEVEL, XP_PER_LEVEL, HP_PER_LEVEL = 30.0, 1, 10, 5


def _amount(value) -> Column:
    col = value if isinstance(value, Column) else F.lit(value)
    return col.try_cast(AMOUNT)


def _plus(a: Column, b: Column) -> Column:
    return (a.cast(_PART) + b.cast(_PART)).cast(AMOUNT)


def _bounded(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def _then(first: Column, step_d: Column, step_lo: Column, step_hi: Column) -> Column:
    """The clamp step that equals ``first`` followed by the given one."""
    return F.struct(
        _plus(first["d"], step_d).alias("d"),
        _bounded(_plus(first["lo"], step_d), step_lo, step_hi).alias("lo"),
        _bounded(_plus(first["hi"], step_d), step_lo, step_hi).alias("hi"))


def _apply(x: Column, step: Column) -> Column:
    return _bounded(_plus(x, step["d"]), step["lo"], step["hi"])


def block_steps(numbered: DataFrame, key: list[str], position: str, size: int, *extra: Column) -> DataFrame:
    """One composed step per (key, block) from rows with ``__d``, ``__lo`` and ``__hi``.

    At most ``size`` rows meet in one array.
    """
    rows = F.sort_array(F.collect_list(F.struct(position, "__d", "__lo", "__hi")))
    first = F.element_at("__rows", 1)
    rest = F.slice(F.col("__rows"), F.lit(2), F.size("__rows"))
    start = F.struct(first["__d"].alias("d"), first["__lo"].alias("lo"), first["__hi"].alias("hi"))
    composed = F.aggregate(rest, start, lambda acc, r: _then(acc, r["__d"], r["__lo"], r["__hi"]))
    block = F.floor((F.col(position) - 1) / size).alias("__block")
    return (numbered.groupBy(*key, block).agg(rows.alias("__rows"), F.count(F.lit(1)).alias("__n"), *extra)
            .withColumn("__step", composed).drop("__rows"))


def clamped_fold(df: DataFrame, key, order_by, delta: str, lo: float, hi: float, init: float,
                 name: str = "state", hot_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Final state per key of ``state = min(hi, max(lo, state + delta))``, and the number of steps.

    A NULL or non-finite delta leaves the state as it is, up to the bounds.
    """
    key = as_list(key)
    size = session_block_rows(df.sparkSession) if block_rows is None else block_rows
    numbered = _numbered_steps(df, key, order_by, delta, lo, hi, hot_rows)
    blocks = block_steps(numbered, key, "__k", size)
    # Blocks of blocks, so that the last chain of a key stays short: at most rows / size**2.
    steps = blocks.select(*key, (F.col("__block") + 1).alias("__k"), *[F.col(f"__step.{c}").alias(f"__{c}") for c in ("d", "lo", "hi")],
                          F.col("__n").alias("__rows_in"))
    blocks = block_steps(steps, key, "__k", size, F.sum("__rows_in").alias("__total"))
    chain = F.sort_array(F.collect_list(F.struct("__block", "__step")))
    final = F.aggregate(F.col("__chain"), _amount(init), lambda x, b: _apply(x, b["__step"]))
    return (blocks.groupBy(*key).agg(chain.alias("__chain"), F.sum("__total").alias("n_steps"))
            .select(*key, final.alias(name), "n_steps"))


def _numbered_steps(df: DataFrame, key, order_by, delta, lo, hi, hot_rows) -> DataFrame:
    slim = df.select(*dict.fromkeys([*key, *as_list(order_by), delta]))
    return (number_rows(slim, key, order_by, "__k", hot_rows=hot_rows)
            .select(*key, "__k", F.coalesce(_amount(F.col(delta)), _amount(0)).alias("__d"),
                    _amount(lo).alias("__lo"), _amount(hi).alias("__hi")))


def clamped_fold_plain(df: DataFrame, key, order_by, delta: str, lo: float, hi: float, init: float,
                       name: str = "state") -> DataFrame:
    """The same fold with one array per key: only for keys known to be small."""
    key = as_list(key)
    step = F.coalesce(_amount(F.col(delta)), _amount(0)).alias("__d")
    rows = F.sort_array(F.collect_list(F.struct(*as_list(order_by), step)))
    final = F.aggregate(F.col("__rows"), _amount(init),
                        lambda x, r: _bounded(_plus(x, r["__d"]), _amount(lo), _amount(hi)))
    return (df.groupBy(*key).agg(rows.alias("__rows"))
            .select(*key, final.alias(name), F.size("__rows").cast("bigint").alias("n_steps")))


# ---- levelling -----------------------------------------------------------------------------

def _level_rows(df: DataFrame, key, order_by, d_hp: str, d_xp: str, hot_rows: int | None,
                finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Experience, level and maximum hp after every row and its hp step, then ``finish``.

    Experience never falls (a negative ``d_xp`` raises), so it is a running sum up to its limit. With
    c = floor(xp / 10), one step gives level' = min(level + 1, max(level, c + 1)); as c never falls,
    level after row t is t + min(1, min over s <= t of (c_s + 1 - s)): a running minimum.

    The hp rule of a row is one clamp step: move within [0, old maximum], then add the level bonus.
    """
    key, order_by = as_list(key), as_list(order_by)
    small = T.DecimalType(28, SCALE)
    gain = F.coalesce(quantize(F.col(d_xp), SCALE), F.lit(0).cast(small))
    no_fall = F.raise_error(F.lit("experience must not fall")).cast(small)
    slim = (df.select(*dict.fromkeys([*key, *order_by, d_hp, d_xp]))
            .withColumn("__gain", F.when(gain < 0, no_fall).otherwise(gain)))
    start_level = F.lit(START_LEVEL).cast("bigint")

    def max_hp(level):
        return F.lit(START_HP) + F.lit(float(HP_PER_LEVEL)) * (level - START_LEVEL)

    def steps(rows, heat):
        rows = running(rows, key, order_by, {"__k": ("count", F.lit(1)), "__sum": ("sum", F.col("__gain"))}, heat)
        rows = rows.withColumn("xp", F.least(F.col("__sum"), F.lit(XP_LIMIT).cast(AMOUNT)))
        room = (F.floor(F.col("xp") / XP_PER_LEVEL) + 1 - F.col("__k")).cast("bigint")
        rows = running(rows.withColumn("__room", room), key, order_by, {"__min": ("min", F.col("__room"))}, heat)
        rows = rows.withColumn("level", (F.col("__k") + F.least(start_level, F.col("__min"))).cast("bigint"))
        rows = windowed(rows, key, order_by, lambda w: {"__was": F.coalesce(F.lag("level").over(w), start_level)},
                        back=1, hot_rows=heat)
        bonus = _amount(F.lit(HP_PER_LEVEL) * (F.col("level") - F.col("__was")))
        move = F.coalesce(_amount(F.col(d_hp)), _amount(0))
        return finish(rows.withColumns({
            "max_hp": max_hp(F.col("level")), "__d": _plus(move, bonus), "__lo": bonus,
            "__hi": _plus(_amount(max_hp(F.col("__was"))), bonus)}).drop("__sum", "__gain", "__room", "__min", "__was"))

    return by_heat(slim, key, hot_rows, lambda rows: steps(rows, ALL_COLD),
                   lambda rows: steps(spread(rows, key, order_by), ALL_HOT))


def level_fold(df: DataFrame, key, order_by, d_hp: str, d_xp: str, hot_rows: int | None = None,
               block_rows: int | None = None) -> DataFrame:
    """Final hp, max_hp, xp and level of each key, starting from 30, 30, 0 and 1.

    Each row moves hp within [0, max_hp] and adds experience; then, at most once per row, experience
    of 10 times the level gives one level, 5 more max_hp and 5 more hp.
    """
    key = as_list(key)
    size = session_block_rows(df.sparkSession) if block_rows is None else block_rows

    def finish(rows):
        last = F.max_by(F.struct("xp", "level", "max_hp"), "__k").alias("__last")
        blocks = block_steps(rows, key, "__k", size, last)
        chain = F.sort_array(F.collect_list(F.struct("__block", "__step")))
        hp = F.aggregate(F.col("__chain"), _amount(START_HP), lambda x, b: _apply(x, b["__step"]))
        return (blocks.groupBy(*key)
                .agg(chain.alias("__chain"), F.max_by("__last", "__block").alias("__last"),
                     F.sum("__n").alias("n_steps"))
                .select(*key, hp.alias("hp"), F.col("__last.max_hp").alias("max_hp"),
                        F.col("__last.xp").alias("xp"), F.col("__last.level").alias("level"), "n_steps"))

    return _level_rows(df, key, order_by, d_hp, d_xp, hot_rows, finish)


def level_history(df: DataFrame, key, order_by, d_hp: str, d_xp: str, hot_rows: int | None = None,
                  block_rows: int | None = None) -> DataFrame:
    """hp, max_hp, xp and level after every row.

    The hp a block starts with comes from the composed steps of the blocks before it, so each block
    of rows is replayed on its own.
    """
    key, order_by = as_list(key), as_list(order_by)
    size = session_block_rows(df.sparkSession) if block_rows is None else block_rows
    keep = [*key, *[c for c in order_by if c not in key], "xp", "level", "max_hp"]
    parts = ("d", "lo", "hi")

    def finish(rows):
        flat = block_steps(rows, key, "__k", size).select(
            *key, "__block", *[F.col(f"__step.{c}").cast("double").alias(f"__{c}") for c in parts])
        begin = _replayed(flat.withColumns({"__start": F.lit(START_HP), "__first": F.col("__block") == 0}),
                          key, "__block", [*key, "__block"], "__end", before=True)
        here = rows.withColumn("__block", F.floor((F.col("__k") - 1) / size).cast("bigint"))
        joined = (here.alias("h").join(begin.alias("b"), same_keys("h", "b", [*key, "__block"]))
                  .select(*[F.col(f"h.{c}") for c in [*keep, "__block", "__k"]], F.col("__end").alias("__start"),
                          (F.pmod(F.col("h.__k") - 1, F.lit(size)) == 0).alias("__first"),
                          *[F.col(f"h.__{c}").cast("double").alias(f"__{c}") for c in parts]))
        return _replayed(joined, [*key, "__block"], "__k", keep, "hp")

    return _level_rows(df, key, order_by, d_hp, d_xp, hot_rows, finish)


def _replayed(df: DataFrame, group: list[str], position: str, keep: list[str], name: str, before: bool = False) -> DataFrame:
    """Run clamp steps in order within each group, and give the state after (or before) each.

    ``__start`` is a group's first state and ``__first`` marks its first row. Tasks stream through
    their sorted rows batch by batch and carry one number over.
    """
    placed = df.repartition(*group).sortWithinPartitions(*group, position)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0.0
        for batch in batches:
            first, start, d, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__first", "__start", "__d", "__lo", "__hi"))
            after = states_after(first, start, d, lo, hi, state)
            was = np.where(first, start, np.concatenate([[state], after[:-1]])) if before else after
            state = float(after[-1]) if len(after) else state
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.round(was, SCALE))], names=[*keep, name])

    return placed.mapInArrow(run, schema)


def states_after(first: np.ndarray, start: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: float) -> np.ndarray:
    """States after each of a batch's clamp steps s -> min(hi, max(lo, s + d)), by a prefix scan.

    Clamp steps compose to clamp steps. Each round composes every row with what lies twice as far back as in the round before, so
    n rows take log2(n) rounds over whole arrays. A group's first row forgets what was before it: its step is a constant.
    """
    fixed = np.clip(start + d, lo, hi)
    d, lo, hi = np.where(first, 0.0, d), np.where(first, fixed, lo), np.where(first, fixed, hi)
    reach = 1
    while reach < len(d):
        # Once both bounds agree the way no longer counts; without that, sums of far ways would meet infinity.
        way = np.where(lo == hi, 0.0, d)
        d = np.concatenate([way[:reach], way[:-reach] + way[reach:]])
        low, high = (np.clip(x[:-reach] + way[reach:], lo[reach:], hi[reach:]) for x in (lo, hi))
        lo, hi = np.concatenate([lo[:reach], low]), np.concatenate([hi[:reach], high])
        reach *= 2
    return np.clip(state + np.where(lo == hi, 0.0, d), lo, hi)


def recover_all(df: DataFrame, rate: float = 0.1, stop_at_floor: bool = False) -> DataFrame:
    """Passive recovery applied to final states with ``hp`` and ``max_hp``."""
    return df.withColumn("hp", recover(F.col("hp"), F.col("max_hp"), rate, stop_at_floor))
