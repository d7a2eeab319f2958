"""Grouped aggregates with exact, layout-independent results."""

from __future__ import annotations

from typing import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.accumulators import (NAN, bad_count, exact_sum, fit_count, fits, limb_variance, quantize, stable_mean,
                                      unit_limbs)
from ..functions.scalars import is_finite
from .heat import as_list, same_keys
from .ordered import tail_n


def stable_stats(df: DataFrame, by, value: str, prefix: str = "", scale: int = 10) -> DataFrame:
    """Count, bad values, exact sum, mean and sample variance per group, in one pass."""
    v = F.col(value)
    high, middle, low = unit_limbs(v, scale)
    return df.select(*as_list(by), v, high.alias("__h"), middle.alias("__m"), low.alias("__l")).groupBy(*as_list(by)).agg(
        fit_count(v, scale).alias(f"{prefix}n"),
        bad_count(v, scale).alias(f"{prefix}n_bad"),
        exact_sum(v, scale).alias(f"{prefix}sum"),
        stable_mean(v, scale).alias(f"{prefix}mean"),
        limb_variance(F.col("__h"), F.col("__m"), F.col("__l")).alias(f"{prefix}var"))


# Doubles are cut into whole numbers of 2**(32 b - 54), b counting steps of 32 in the binary exponent.
BIN_BITS, CUT_BITS, PART_BITS = 32, 44, 40


def kahan_sum(df: DataFrame, key, value: str, name: str = "kahan_sum") -> DataFrame:
    """Compensated sum in double for values no decimal can hold; neither order nor layout plays a part.

    Every double is a whole number of a power of two that goes with its size. These whole numbers are
    summed exactly per (key, size class), combined before the shuffle; the at most 70 classes of a key are added once,
    from the largest down, with compensation. NaN, and infinities of both signs, give NaN; one infinity gives itself.
    """
    key = as_list(key)
    x = F.col("__x")
    base = df.select(*key, F.col(value).cast("double").alias("__x")).where(x.isNotNull())
    finite = is_finite(x)
    bin_ = F.when(finite & (x != 0), F.floor(F.log2(F.abs(x)) / F.lit(float(BIN_BITS)))).otherwise(F.lit(0)).cast("int")
    # Two steps keep the factors within the range of a double.
    half = F.pow(F.lit(2.0), F.lit(27.0) - F.col("__bin") * F.lit(BIN_BITS / 2))
    units = F.when(finite, x * half * half).otherwise(F.lit(0.0))
    rows = base.withColumn("__bin", bin_).withColumn("__u", units)
    parts = rows.groupBy(*key, "__bin").agg(
        F.sum(F.floor(F.col("__u") / F.lit(2.0 ** CUT_BITS)).cast("decimal(20,0)")).alias("__high"),
        F.sum((F.col("__u") - F.floor(F.col("__u") / F.lit(2.0 ** CUT_BITS)).cast("double") * F.lit(2.0 ** CUT_BITS)).cast("bigint").cast("decimal(20,0)")).alias("__low"),
        F.bool_or(F.isnan(x)).alias("__nan"), F.bool_or(x == float("inf")).alias("__pos"), F.bool_or(x == float("-inf")).alias("__neg"))

    def pieces(total: Column, shift: int) -> list[Column]:
        """The sum as doubles that hold it exactly, in units of the class."""
        step = F.lit(2 ** PART_BITS).cast("decimal(20,0)")
        quotient = F.call_function("div", total, step)
        rest = (total - quotient.cast("decimal(19,0)") * step).cast("double")
        return [quotient.cast("double") * F.lit(2.0 ** (PART_BITS + shift)), rest * F.lit(2.0 ** shift)]

    back = F.pow(F.lit(2.0), F.col("__bin") * F.lit(BIN_BITS / 2) - F.lit(27.0))
    terms = F.array(*[p * back * back for p in pieces(F.col("__high"), CUT_BITS) + pieces(F.col("__low"), 0)])
    classes = parts.select(*key, "__nan", "__pos", "__neg", F.struct((-F.col("__bin")).alias("order"), terms.alias("terms")).alias("__class"))

    def add(acc, term):
        total = acc["s"] + term
        lost = F.when(F.abs(acc["s"]) >= F.abs(term), (acc["s"] - total) + term).otherwise((term - total) + acc["s"])
        return F.struct(total.alias("s"), (acc["c"] + lost).alias("c"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list("__class")), lambda c: c["terms"]))
    grouped = classes.groupBy(*key).agg(ordered.alias("__terms"), *[F.bool_or(c).alias(c) for c in ("__nan", "__pos", "__neg")])
    total = F.aggregate("__terms", start, add, lambda acc: acc["s"] + acc["c"])
    special = (F.when(F.col("__nan") | (F.col("__pos") & F.col("__neg")), F.lit(NAN)).when(F.col("__pos"), F.lit(float("inf")))
               .when(F.col("__neg"), F.lit(float("-inf"))))
    return grouped.select(*key, F.coalesce(special, total).alias(name))


def ordered_kahan_sum(df: DataFrame, key, order_by, value: str, name: str = "kahan_sum") -> DataFrame:
    """The literal compensated recurrence y = x - c, t = s + y, c = (t - s) - y, s = t over a key's rows in order, in double.

    Tasks stream through sorted rows batch by batch and carry (s, c) over, so a key of any size takes the memory of a batch;
    as every step needs the one before, a key is summed by one task. NULL is left out; NaN and infinities go into the sum
    as they are. ``order_by`` should be a total order within the key. A key without values gives 0.
    """
    key, order_by = as_list(key), as_list(order_by)
    numbered = df.select(*dict.fromkeys([*key, *order_by]), F.col(value).cast("double").alias("__x"))
    sorted_rows = numbered.repartition(*key).sortWithinPartitions(*key, *order_by).select(*key, F.struct(*key).alias("__key"), "__x")
    # Keys are told apart by their text, in which NULL differs from all values.
    marked = sorted_rows.withColumn("__key", F.to_json("__key", {"ignoreNullFields": "false"}))
    schema = T.StructType([*df.select(*key).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, s, c = None, None, 0.0, 0.0
        for batch in batches:
            keys, values = batch.column("__key").to_pylist(), batch.column("__x").to_pylist()
            done, sums = [], []
            for i, (k, x) in enumerate(zip(keys, values)):
                if k != now:
                    if now is not None:
                        done.append(i)
                        sums.append(s)
                    now, s, c = k, 0.0, 0.0
                if x is not None:
                    y = x - c
                    t = s + y
                    s, c = t, (t - s) - y
            if done:
                # The key that ends before row i is that of row i - 1, or the one held from the batch before.
                rows = [batch.slice(i - 1, 1) if i else held for i in done]
                out = pa.Table.from_batches([r.select(key) for r in rows]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sums, pa.float64())], names=[*key, name])
            if len(batch):
                held = batch.slice(len(batch) - 1, 1)
        if now is not None:
            yield pa.RecordBatch.from_arrays([*held.select(key).columns, pa.array([s], pa.float64())], names=[*key, name])

    return marked.mapInArrow(run, schema)


def logsumexp(df: DataFrame, by, value: str, name: str = "lse", on_nan: str = "error", limit: float = 1e300) -> DataFrame:
    """log(sum(exp(x))) per group, from exact sums per (group, nearest multiple of 32), combined before the shuffle.

    ``on_nan``: ``error`` raises, ``null`` leaves the value out, ``low`` counts it as the lowest.
    Infinities become plus or minus ``limit``. An empty group gives NULL.
    """
    by = as_list(by)
    x = F.col(value).cast("double")
    if on_nan == "error":
        x = F.when(F.isnan(x), F.raise_error(F.lit(f"NaN in {value}")).cast("double")).otherwise(x)
    elif on_nan == "null":
        x = F.when(~F.isnan(x), x)
    elif on_nan == "low":
        x = F.when(F.isnan(x), F.lit(-limit)).otherwise(x)
    else:
        raise ValueError(f"unknown on_nan {on_nan!r}")
    x = F.when(x == float("inf"), limit).when(x == float("-inf"), -limit).otherwise(x)
    base = df.select(*by, x.alias("__x")).withColumn("__b", F.rint(F.col("__x") / 32.0))
    buckets = base.groupBy(*by, "__b").agg(F.sum(F.exp(F.col("__x") - F.col("__b") * 32.0).cast(T.DecimalType(28, 20))).alias("__s"))
    buckets = buckets.withColumn("__top", F.max("__b").over(Window.partitionBy(*by)))
    scaled = (F.col("__s").cast("double") * F.exp((F.col("__b") - F.col("__top")) * 32.0)).cast(T.DecimalType(38, 18))
    return buckets.groupBy(*by).agg((F.max("__top") * 32.0 + F.log(F.sum(scaled).cast("double"))).alias(name))


LAST_NORMS = 256


def run_metrics(df: DataFrame, key, ts: str, values: Mapping[str, str], distinct: str, losses: str | None = None,
                norms: str | None = None, order_by=(), seed: int | None = None) -> DataFrame:
    """One row per run: duration and last second in event time, steps, distinct kinds, seed, and count, mean and
    variance of each named value. ``losses`` adds a nested record of the same for a loss column, and ``norms`` one
    for a norm column along with its last ``LAST_NORMS`` values in the order ``order_by``."""
    key = as_list(key)
    last = F.unix_micros(F.max(F.col(ts).cast("timestamp")))
    seconds = (last - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / F.lit(1e6)
    aggs = [seconds.alias("duration_s"), F.floor(last / F.lit(1_000_000)).cast("bigint").alias("timestamp"),
            F.lit(seed).cast("bigint").alias("seed"), F.count(F.lit(1)).alias("depth"),
            F.count_distinct(F.col(distinct)).alias("encounters")]
    measured = dict.fromkeys([*values.values(), *([losses] if losses else []), *([norms] if norms else [])])
    slim = df.select(*dict.fromkeys([*key, ts, distinct, *measured]),
                     *[limb.alias(f"__{side}_{c}") for c in measured for side, limb in zip("hml", unit_limbs(F.col(c)))])

    def three(column, prefix):
        return [fit_count(F.col(column)).alias(f"{prefix}_count"), stable_mean(F.col(column)).alias(f"{prefix}_mean"),
                limb_variance(*[F.col(f"__{side}_{column}") for side in "hml"]).alias(f"{prefix}_var")]

    for prefix, column in values.items():
        aggs += three(column, prefix)
    if losses:
        aggs.append(F.struct(*three(losses, "loss")).alias("grad_loss_stats"))
    if norms:
        aggs.append(F.struct(*three(norms, "norm")).alias("grad_norm_stats"))
    runs = slim.groupBy(*key).agg(*aggs)
    if not norms:
        return runs
    order_by = as_list(order_by)
    newest = tail_n(df.select(*dict.fromkeys([*key, *order_by, norms])), key, order_by, LAST_NORMS)
    lists = newest.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(norms).alias("__n")))).alias("__last"))
    joined = runs.alias("r").join(lists.alias("l"), same_keys("r", "l", key), "left").select("r.*", "l.__last")
    return joined.withColumn("grad_norm_last", F.transform("__last", lambda e: e["__n"])).drop("__last")


def l1_distance(left: DataFrame, right: DataFrame, key, value: str, by=(), name: str = "l1",
                scale: int = 15) -> DataFrame:
    """Sum of absolute differences of two tables matched on ``key``, per group ``by``.

    Rows found on one side only count with their full size. Both sides are stacked and summed per
    key with opposite signs, which combines before the shuffle and never pairs rows. A value that is not
    finite, or too large for ``scale`` decimals, makes its group's distance NaN; NULL counts as nothing.
    """
    key, by = as_list(key), as_list(by)
    groups = list(dict.fromkeys([*by, *key]))

    def side(rows: DataFrame, sign: int) -> DataFrame:
        v = F.col(value).cast("double")
        return rows.select(*groups, quantize(v * F.lit(sign), scale).alias("__v"), (~fits(v, scale)).alias("__bad"))

    signed = side(left, 1).unionByName(side(right, -1))
    gaps = signed.groupBy(*groups).agg(F.abs(F.sum("__v")).cast(T.DecimalType(28, scale)).alias("__gap"), F.bool_or("__bad").alias("__bad"))
    total = F.when(F.coalesce(F.bool_or("__bad"), F.lit(False)), F.lit(NAN)).otherwise(F.sum("__gap").cast("double"))
    return gaps.groupBy(*by).agg(total.alias(name))


def log_loss(df: DataFrame, prob_of_label: Column, name: str = "log_loss") -> DataFrame:
    """Mean of -ln(p of the true label), from an exact sum.

    A label with probability 0 makes the loss infinite; NaN or a negative probability makes it NaN. NULL is left out.
    """
    p = prob_of_label.cast("double")
    wrong = F.coalesce(F.bool_or(F.isnan(p) | (p < 0)), F.lit(False))
    endless = F.coalesce(F.bool_or(p == 0), F.lit(False))
    mean = stable_mean(-F.log(F.when(p > 0, p)))
    return df.agg(F.when(wrong, F.lit(NAN)).when(endless, F.lit(float("inf"))).otherwise(mean).alias(name))


def global_norm(df: DataFrame, by, norm: str, name: str = "norm") -> DataFrame:
    """Root of the sum of squared norms per group.

    Norms are divided by the largest one of their group, so squares neither overflow nor vanish, and their sum is exact.
    NaN gives NaN and infinity gives infinity; NULL is left out. The group's largest norm is joined back by key.
    """
    by = as_list(by)
    keys = by or ["__all"]
    base = df.withColumns({} if by else {"__all": F.lit(1)}).select(*keys, F.abs(F.col(norm).cast("double")).alias("__n")).where("__n is not null")
    tops = base.groupBy(*keys).agg(F.max("__n").alias("__top"))
    joined = base.alias("b").join(tops.alias("t"), same_keys("b", "t", keys)).select("b.*", "t.__top")
    share = F.when((F.col("__top") > 0) & (F.col("__top") < float("inf")), F.col("__n") / F.col("__top")).otherwise(F.lit(0.0))
    squares = joined.groupBy(*keys, "__top").agg(F.sum((share * share).cast(T.DecimalType(28, 18))).cast("double").alias("__s"))
    value = F.when(F.isnan("__top") | (F.col("__top") == float("inf")), F.col("__top")).otherwise(F.col("__top") * F.sqrt("__s"))
    return squares.select(*by, value.alias(name))


def canonical_order(col) -> Column:
    """Entries of a map, or elements of an array of records, in sorted order."""
    return F.array_sort(col)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table under a total order (a distributed top-k)."""
    return df.orderBy(*order).limit(n)
