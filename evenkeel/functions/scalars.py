"""Row-local numeric, text and array expressions."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import normal

INF = float("inf")

# They must agree with published behaviour for equal results.
ACTIONS = ("attack", "defend", "heal", "flee", "special")
SCORE_LIMIT = 1e6
PROBABILITY_FLOOR = 1e-12
MIN_TEMPERATURE = 1e-12
ARGMAX_TEMPERATURE = 1e-8
SENTINEL = 1e9
MAX_NORM = 5.0
NORM_GUARD = 1e-6
NOISE_SCALE = 1e-3
XP_LIMIT = 1e12
LEVEL_LIMIT = 9999


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# ---- ids and paths -------------------------------------------------------------------------

def stable_id(col, length: int = 32) -> Column:
    """SHA-256 hex prefix of the value's decimal text."""
    return F.substring(F.sha2(_col(col).cast("string"), 256), 1, length)


def short_id(col, length: int = 12) -> Column:
    """SHA-1 hex prefix."""
    return F.substring(F.sha1(_col(col).cast("string")), 1, length)


def sanitize_path(col) -> Column:
    """Last path element (at most 200 characters) and a short id of the whole path."""
    path = _col(col)
    base = F.substring(F.substring_index(path, "/", -1), 1, 200)
    return F.concat(base, F.lit("_"), short_id(path))


# ---- finite values and ranges --------------------------------------------------------------

def is_finite(col) -> Column:
    """True for numbers, False for NULL, NaN and infinities."""
    c = _col(col).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def replace_nonfinite(col, nan=-SENTINEL, pos=SENTINEL, neg=-SENTINEL) -> Column:
    """Put given values in place of NaN and the infinities; NULL stays NULL."""
    c = _col(col)
    return (F.when(F.isnan(c), _number(nan)).when(c == F.lit(INF), _number(pos))
            .when(c == F.lit(-INF), _number(neg)).otherwise(c))


def clamp(col, lo, hi) -> Column:
    """Bring a value into [lo, hi]; NULL stays NULL. Replace NaN first: it counts as largest."""
    c = _col(col)
    return F.when(c.isNotNull(), F.least(_number(hi), F.greatest(_number(lo), c)))


def noise_impute(col_name: str, seed: int, *key, finite=None) -> Column:
    """Small keyed normal noise in place of non-finite values; the domain is the column's name."""
    value = F.col(col_name)
    noise = F.lit(NOISE_SCALE) * normal(seed, col_name, *key)
    return F.when(is_finite(value) if finite is None else finite, value).otherwise(noise)


# ---- features ------------------------------------------------------------------------------

def ratio_feature(num, den, floor: float = 1.0) -> Column:
    """num / max(floor, den); a NULL denominator counts as the floor."""
    bottom = _col(den) if isinstance(den, str) else _number(den)
    return _col(num).cast("double") / F.greatest(bottom.cast("double"), F.lit(float(floor)))


def log_depth(depth, base: float = 1.0, rate: float = 0.5, cap: float = 100.0) -> Column:
    d = F.greatest(_col(depth).cast("double"), F.lit(0.0))
    return F.least(F.lit(float(cap)), F.lit(float(base)) + F.lit(float(rate)) * F.log1p(d))


def temperature(depth) -> Column:
    """Cools from 1.0 by 0.005 per step and stops at 0.5."""
    return F.greatest(F.lit(0.5), F.lit(1.0) - F.lit(0.005) * _col(depth).cast("double"))


def actor_features(hp, max_hp, xp, level) -> Column:
    lvl = _col(level).cast("double")
    return F.array(ratio_feature(hp, _col(max_hp)),
                   ratio_feature(xp, F.lit(10.0) * F.greatest(lvl, F.lit(1.0))),
                   lvl / F.lit(50.0))


def opponent_features(difficulty, hp, attack) -> Column:
    return F.array(_col(difficulty).cast("double") / F.lit(10.0), _col(hp).cast("double") / F.lit(200.0),
                   _col(attack).cast("double") / F.lit(50.0))


def encode_category(col, vocab: Sequence[str] = ACTIONS) -> Column:
    """Position of a label in a fixed vocabulary; unknown labels give NULL."""
    position = F.array_position(F.array(*[F.lit(v) for v in vocab]), _col(col))
    return F.when(position > 0, (position - 1).cast("int"))


def decode_category(index, vocab: Sequence[str] = ACTIONS) -> Column:
    labels = F.array(*[F.lit(v) for v in vocab])
    return F.when(_col(index) >= 0, F.try_element_at(labels, (_col(index) + 1).cast("int")))


# ---- arrays --------------------------------------------------------------------------------

def argmax_array(col) -> Column:
    """Index of the largest element, the first on ties; NULL for an empty array."""
    a = _col(col)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sum_array(col) -> Column:
    """Sum in element order, in double."""
    return F.aggregate(_col(col), F.lit(0.0), lambda total, x: total + x.cast("double"))


def l2_norm(col) -> Column:
    return F.sqrt(F.aggregate(_col(col), F.lit(0.0),
                              lambda total, x: total + x.cast("double") * x.cast("double")))


def with_value(expr: Column, use: Callable[[Column], Column]) -> Column:
    """``use(expr)`` with ``expr`` computed once per row, also where ``use`` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(expr), use), 1)


def clip_by_norm(col, max_norm: float = MAX_NORM) -> Column:
    """Scale a vector down so that its norm is at most ``max_norm``."""
    factor = F.least(F.lit(1.0), F.lit(float(max_norm)) / (l2_norm(col) + F.lit(NORM_GUARD)))
    return with_value(factor, lambda f: F.transform(_col(col), lambda x: x.cast("double") * f))


def logsumexp_array(col) -> Column:
    a = _col(col)
    return with_value(F.array_max(a), lambda top: top + F.log(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + F.exp(x - top))))


def softmax_array(col, temp=1.0) -> Column:
    """Guarded softmax of one score array per row; needs no shuffle.

    NaN and NULL elements count as the low sentinel. Temperatures below 1e-8 give a one-hot vector at the first
    largest score. Probabilities are floored and made to sum to 1 again.
    """
    t = F.greatest(F.lit(MIN_TEMPERATURE), _number(temp).cast("double"))

    def one_hot(scores):
        return with_value(argmax_array(scores), lambda best: F.transform(
            scores, lambda x, i: F.when(i == best, 1.0).otherwise(0.0)))

    def floored(scaled):
        return with_value(logsumexp_array(scaled), lambda lse: F.transform(
            scaled, lambda x: F.greatest(F.lit(PROBABILITY_FLOOR), F.exp(x - lse))))

    def to_one(parts):
        return with_value(sum_array(parts), lambda total: F.transform(parts, lambda p: p / total))

    def probabilities(scores):
        scaled = F.transform(scores, lambda x: clamp(x / t, -SCORE_LIMIT, SCORE_LIMIT))
        return F.when(t < ARGMAX_TEMPERATURE, one_hot(scores)).otherwise(
            with_value(with_value(scaled, floored), to_one))

    return with_value(F.transform(_col(col), lambda x: F.coalesce(replace_nonfinite(x.cast("double")), F.lit(-SENTINEL))), probabilities)


def pick_index(probs, u) -> Column:
    """First index whose running probability exceeds ``u``; the last positive one if none does.

    A total that is not finite or not positive falls back to the largest entry.
    """
    start = F.struct(F.lit(0.0).alias("run"), F.lit(-1).alias("hit"), F.lit(-1).alias("last"),
                     F.lit(0).alias("i"))

    def draw(given):
        p, total, r = given["p"], given["total"], given["u"]

        def step(acc, x):
            run = acc["run"] + x / total
            return F.struct(
                run.alias("run"),
                F.when((acc["hit"] < 0) & (r < run), acc["i"]).otherwise(acc["hit"]).alias("hit"),
                F.when(x > 0, acc["i"]).otherwise(acc["last"]).alias("last"),
                (acc["i"] + 1).alias("i"))

        drawn = F.aggregate(p, start, step, lambda acc: F.when(acc["hit"] >= 0, acc["hit"]).otherwise(acc["last"]))
        return F.when(is_finite(total) & (total > 0), drawn).otherwise(argmax_array(p))

    p = _col(probs)
    return with_value(F.struct(p.alias("p"), sum_array(p).alias("total"), _number(u).alias("u")), draw)


# ---- text ----------------------------------------------------------------------------------

def format_line(template: str, *cols) -> Column:
    """printf-style text; cast to int before the call to cut numbers toward zero."""
    return F.format_string(template, *[_col(c) for c in cols])


def whole(col) -> Column:
    """Cut toward zero to an integer."""
    return _col(col).cast("bigint")


# ---- states ------------------------------------------------------------------------------

def recover(hp, max_hp, rate: float = 0.1, stop_at_floor: bool = False) -> Column:
    """Passive recovery at the end of a group: a whole part of ``max_hp``, never above it.

    With ``stop_at_floor`` a state that reached 0 stays there.
    """
    h, m = _col(hp).cast("double"), _col(max_hp).cast("double")
    healed = F.least(m, h + whole(F.lit(float(rate)) * m).cast("double"))
    return F.when(h <= 0, h).otherwise(healed) if stop_at_floor else healed
