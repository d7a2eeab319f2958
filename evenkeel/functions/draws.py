"""Keyed random draws: each value is a pure function of (seed, domain, key).

Nothing is remembered between draws, so a draw in one domain cannot move another, a retried task
draws the same values, and the layout of the table plays no part. Resolution is 32 bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 1234567890


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def draw_text(seed: int, domain: str, *key) -> Column:
    """The text a draw is computed from: seed, domain and key parts joined by ``|``.

    Text parts carry their length in front, so that different keys never give the same text, and NULL is no text.
    """
    def part(k) -> Column:
        value = _col(k)
        text = value.cast("string")
        told = F.when(F.typeof(value) == "string", F.concat(F.length(text).cast("string"), F.lit(":"), text)).otherwise(text)
        return F.coalesce(told, F.lit("\\N"))

    return F.concat_ws("|", F.lit(str(int(seed))), F.lit(domain), *[part(k) for k in key])


def uniform(seed: int, domain: str, *key) -> Column:
    """Uniform in [0, 1)."""
    digits = F.substring(F.md5(draw_text(seed, domain, *key)), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def uniform_int(lo, hi, seed: int, domain: str, *key) -> Column:
    """Uniform integer in [lo, hi); both ends may be columns."""
    low, high = _number(lo), _number(hi)
    return (low + F.floor(uniform(seed, domain, *key) * (high - low))).cast("bigint")


def bernoulli(p, seed: int, domain: str, *key) -> Column:
    """True with probability ``p``; a larger ``p`` only adds rows."""
    return uniform(seed, domain, *key) < _number(p)


def normal(seed: int, domain: str, *key) -> Column:
    """Standard normal by Box-Muller from two draws of sub-domains."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, f"{domain}/radius", *key)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, f"{domain}/angle", *key))
