"""Operators over rows in a total order within a key.

``order_by`` must be a total order within the key: end it with a unique column. Keys that fit a
task use a plain window. Hot keys are range-partitioned by (key, order), so that many tasks share
one key, and what earlier tasks hold is carried forward from per-task summaries. There is at most
one summary row per task and hot key, so summaries can be broadcast.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import NAN, VARIANCE_TERMS, mean_of, quantize, unit_limbs, variance_of, variance_sums, variance_terms
from ..session import block_rows as session_block_rows
from ..session import cut_lineage
from .heat import as_list, attach, by_heat

RUN = (Window.unboundedPreceding, Window.currentRow)
RN, CHUNK, BLOCK = "__rn", "__chunk", "__block"


def _ordering(order_by: Sequence[str], desc: bool) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in order_by]


def _window(key: Sequence[str], order: Sequence) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def spread(hot: DataFrame, key: Sequence[str], order_by: Sequence[str], desc: bool = False) -> DataFrame:
    """Number the rows of hot keys from 1, with many tasks per key.

    Adds ``__rn`` (position within the key) and ``__chunk`` (the range partition); rows that carry
    them already are left as they are. The placement is stored before it is used twice, since range
    bounds are sampled and could change in a rerun.
    """
    if RN in hot.columns:
        return hot
    order = _ordering(order_by, desc)
    tasks = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (hot.repartitionByRange(tasks, *[F.col(k) for k in key], *order)
              .sortWithinPartitions(*[F.col(k) for k in key], *order)
              .withColumn("__at", F.monotonically_increasing_id()))
    placed = cut_lineage(placed).withColumn(CHUNK, F.shiftright("__at", 33))
    spans = placed.groupBy(*key, CHUNK).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = _window(key, [CHUNK]).rowsBetween(Window.unboundedPreceding, -1)
    carry = spans.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (attach(placed, carry, [*key, CHUNK])
            .withColumn(RN, F.col("__at") - F.col("__first") + F.col("__before") + 1)
            .drop("__at", "__first", "__before"))


def _tidy(done: DataFrame, given: DataFrame) -> DataFrame:
    """Keep the placement columns only where the caller handed them in."""
    return done if RN in given.columns else done.drop(RN, CHUNK)


def number_rows(df: DataFrame, key, order_by, name: str = "rn", desc: bool = False,
                hot_rows: int | None = None) -> DataFrame:
    """Row number within each key, from 1."""
    key, order_by = as_list(key), as_list(order_by)
    number = F.row_number().over(_window(key, _ordering(order_by, desc))).cast("bigint")

    def hot(rows):
        return _tidy(spread(rows, key, order_by, desc).withColumn(name, F.col(RN)), rows)

    return by_heat(df, key, hot_rows, lambda rows: rows.withColumn(name, number), hot)


def _joined(kind: str, left: Column, right: Column, dtype: T.DataType) -> Column:
    if kind == "min":
        return F.least(left, right)
    if kind == "max":
        return F.greatest(left, right)
    if isinstance(dtype, T.DecimalType):
        # one digit of head room, so that the sum keeps its scale
        part = T.DecimalType(min(dtype.precision, 37), dtype.scale)
        total = F.coalesce(left.cast(part), F.lit(0).cast(part)) + F.coalesce(right.cast(part), F.lit(0).cast(part))
        return F.when(left.isNotNull() | right.isNotNull(), total.cast(dtype))
    return F.when(left.isNotNull() | right.isNotNull(), F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0)))


_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def running(df: DataFrame, key, order_by, columns: Mapping[str, tuple[str, Column]],
            hot_rows: int | None = None) -> DataFrame:
    """Running ``sum``, ``count``, ``min`` or ``max`` from the first row of the key to this one.

    Pass decimals or whole numbers to ``sum``: sums of doubles depend on where a hot key is cut.
    """
    key, order_by = as_list(key), as_list(order_by)
    over = _window(key, order_by).rowsBetween(*RUN)
    fold = {name: ("sum" if kind == "count" else kind) for name, (kind, _) in columns.items()}

    def cold(rows):
        return rows.withColumns({name: _AGGREGATES[kind](value).over(over) for name, (kind, value) in columns.items()})

    def hot(rows):
        placed = spread(rows, key, order_by)
        local = _window([*key, CHUNK], [RN]).rowsBetween(*RUN)
        earlier = _window(key, [CHUNK]).rowsBetween(Window.unboundedPreceding, -1)
        totals = placed.groupBy(*key, CHUNK).agg(
            *[_AGGREGATES[kind](value).alias(f"__t_{name}") for name, (kind, value) in columns.items()])
        carry = totals.select(*key, CHUNK, *[
            _AGGREGATES[fold[name]](F.col(f"__t_{name}")).over(earlier).alias(f"__c_{name}") for name in columns])
        here = placed.withColumns({f"__l_{name}": _AGGREGATES[kind](value).over(local)
                                   for name, (kind, value) in columns.items()})
        types = {f.name: f.dataType for f in here.schema.fields}
        merged = attach(here, carry, [*key, CHUNK]).withColumns({
            name: _joined(fold[name], F.col(f"__l_{name}"), F.col(f"__c_{name}"), types[f"__l_{name}"])
            for name in columns})
        return _tidy(merged.drop(*[f"__{side}_{name}" for side in "lc" for name in columns]), rows)

    return by_heat(df, key, hot_rows, cold, hot)


def windowed(df: DataFrame, key, order_by, build: Callable[[WindowSpec], Mapping[str, Column]],
             back: int = 0, ahead: int = 0, hot_rows: int | None = None,
             block_rows: int | None = None) -> DataFrame:
    """Columns that look at most ``back`` rows back and ``ahead`` rows ahead.

    ``build`` receives the ordered window. Hot keys are cut into blocks of rows by position, and
    each block also gets copies of its neighbours' border rows, which are dropped at the end.
    """
    key, order_by = as_list(key), as_list(order_by)
    size = max(session_block_rows(df.sparkSession) if block_rows is None else block_rows, back, ahead, 1)
    position = F.pmod(F.col(RN) - 1, F.lit(size))
    home = F.floor((F.col(RN) - 1) / size).cast("bigint")
    targets = F.array_compact(F.array(
        home,
        F.when(position >= size - back, home + 1),
        F.when((position < ahead) & (home > 0), home - 1)))

    def hot(rows):
        copies = spread(rows, key, order_by).withColumn("__home", home).withColumn(BLOCK, F.explode(targets))
        done = copies.withColumns(dict(build(_window([*key, BLOCK], [RN])))).filter(F.col(BLOCK) == F.col("__home"))
        return _tidy(done.drop("__home", BLOCK), rows)

    return by_heat(df, key, hot_rows, lambda rows: rows.withColumns(dict(build(_window(key, order_by)))), hot)


# ---- row selections ------------------------------------------------------------------------

# A key's rows are first limited within so many parts, so that no task meets all rows of a hot key.
LIMIT_PARTS = 64


def _first_n(df: DataFrame, key, order_by, n: int, desc: bool = False) -> DataFrame:
    """The first ``n`` rows of each key with their number ``__k``; nothing runs while this is built.

    Rows are dealt by (key, part) and limited there, which leaves at most ``LIMIT_PARTS`` times ``n`` rows of a key for
    the second step.
    """
    key, order_by = as_list(key), as_list(order_by)
    order = _ordering(order_by, desc)
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*order_by), F.lit(LIMIT_PARTS)))
    few = dealt.withColumn("__k", F.row_number().over(_window([*key, "__part"], order))).filter(F.col("__k") <= n).drop("__part")
    return few.withColumn("__k", F.row_number().over(_window(key, order))).filter(F.col("__k") <= n)


def head_n(df: DataFrame, key, order_by, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return _first_n(df, key, order_by, n).drop("__k")


def tail_n(df: DataFrame, key, order_by, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return _first_n(df, key, order_by, n, desc=True).drop("__k")


def head_then_tail(df: DataFrame, key, order_by, n: int = 4096, k: int = 256) -> DataFrame:
    """Of the first ``n`` rows of each key, the last ``k``; the second step keeps the partitioning of the first."""
    back = F.row_number().over(_window(as_list(key), [F.col("__k").desc()]))
    return _first_n(df, key, order_by, n).withColumn("__b", back).filter(F.col("__b") <= k).drop("__k", "__b")


def recency_buffer(df: DataFrame, key, order_by, n: int = 16_384) -> DataFrame:
    """Bounded first-in-first-out buffer: the newest ``n`` rows of each key."""
    return tail_n(df, key, order_by, n)


def every_nth(df: DataFrame, key, order_by, n: int = 10, hot_rows: int | None = None) -> DataFrame:
    """Rows n, 2n, 3n... of each key."""
    numbered = number_rows(df, key, order_by, "__k", hot_rows=hot_rows)
    return numbered.filter(F.col("__k") % n == 0).drop("__k")


def shard_index(df: DataFrame, key, order_by, n: int = 512, name: str = "shard",
                hot_rows: int | None = None) -> DataFrame:
    """Number the runs of ``n`` rows of each key from 0."""
    numbered = number_rows(df, key, order_by, "__k", hot_rows=hot_rows)
    return numbered.withColumn(name, F.floor((F.col("__k") - 1) / n).cast("bigint")).drop("__k")


# ---- derived columns -----------------------------------------------------------------------

def pre_post_pairs(df: DataFrame, key, order_by, cols: Sequence[str], delta: Sequence[str] = (),
                   hot_rows: int | None = None) -> DataFrame:
    """``pre`` and ``post`` records of each step, and ``delta_*`` of the named columns.

    The first row of a key has a NULL ``pre``.
    """
    def build(w: WindowSpec):
        here = F.struct(*cols)
        steps = {f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in delta}
        return {"pre": F.lag(here).over(w), "post": here, **steps}

    return windowed(df, key, order_by, build, back=1, hot_rows=hot_rows)


def with_delta(df: DataFrame, key, order_by, col: str, name: str = "delta",
               hot_rows: int | None = None) -> DataFrame:
    return windowed(df, key, order_by, lambda w: {name: F.col(col) - F.lag(col).over(w)}, back=1,
                    hot_rows=hot_rows)


def running_stats(df: DataFrame, key, order_by, col: str, hot_rows: int | None = None) -> DataFrame:
    """Count, mean and sample variance after each step, from exact running sums."""
    value = F.col(col)
    limbs = dict(zip(("__h", "__m", "__l"), unit_limbs(value)))
    terms = variance_terms(*[F.col(name) for name in limbs])
    sums = running(df.withColumns(limbs), key, order_by, {
        "run_n": ("count", F.col("__l")),
        "run_sum": ("sum", quantize(value)),
        **{f"__{name}": ("sum", term) for name, term in terms.items()},
    }, hot_rows)
    n = F.col("run_n")
    return sums.withColumns({
        "run_mean": mean_of(F.col("run_sum"), n),
        "run_var": F.coalesce(variance_of(n, variance_sums({name: F.col(f"__{name}") for name in VARIANCE_TERMS})), F.lit(NAN)),
    }).drop(*limbs, *[f"__{name}" for name in VARIANCE_TERMS])


def sequence_features(df: DataFrame, key, order_by, features: Sequence[str], k: int = 4,
                      mode: str = "history", name: str = "seq", hot_rows: int | None = None) -> DataFrame:
    """A k-by-d array per row, zeros on the left.

    ``history`` fills it with the last k rows of the key; ``current_only`` puts the current row in
    the last slot and needs no window.
    """
    row = F.array(*[F.col(c).cast("double") for c in features])
    blank = F.array(*[F.lit(0.0) for _ in features])
    if mode == "current_only":
        return df.withColumn(name, F.concat(F.array_repeat(blank, k - 1), F.array(row)))
    if mode != "history":
        raise ValueError(f"unknown mode {mode!r}")

    def build(w: WindowSpec):
        seen = F.collect_list(row).over(w.rowsBetween(-(k - 1), 0))
        return {name: F.concat(F.array_repeat(blank, k - F.size(seen)), seen)}

    return windowed(df, key, order_by, build, back=k - 1, hot_rows=hot_rows)
