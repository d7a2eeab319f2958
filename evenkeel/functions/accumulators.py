"""Aggregate expressions that give the same bits for every partitioning.

Values are rounded once to a fixed number of decimals; sums of decimals are exact, so map-side
partial sums may be merged in any order. NULL, NaN, infinite and too large values are left out of
the sums and can be counted with ``bad_count``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import is_finite

NAN = float("nan")


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _split(x: Column, scale: int) -> tuple[Column, Column]:
    """Whole part and decimals of a double as whole numbers: the one rounding rule of this module.

    The fraction is exact in binary; it is scaled and rounded half to even.
    """
    whole = F.floor(x)
    return whole, F.rint((x - whole) * F.lit(10.0 ** scale)).cast("bigint")


def quantize(col, scale: int = 10) -> Column:
    """The value rounded to ``scale`` decimals as ``decimal(28, scale)``, NULL where it cannot be held."""
    x = _col(col).cast("double")
    whole, digits = _split(x, scale)
    value = whole.cast("decimal(20,0)") + digits.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))
    return F.when(fits(x, scale), value.cast(T.DecimalType(28, scale)))


def fits(col, scale: int = 10) -> Column:
    """True for numbers that ``quantize`` can hold; NULL for NULL."""
    x = _col(col).cast("double")
    return ~F.isnan(x) & (F.abs(x) < F.lit(10.0 ** min(18, 28 - scale)))


def fit_count(col, scale: int = 10) -> Column:
    return F.count(F.when(fits(col, scale), F.lit(1)))


def bad_count(col, scale: int = 10) -> Column:
    """Non-NULL values that the exact sums leave out."""
    return F.count_if(~fits(col, scale))


def exact_sum(col, scale: int = 10) -> Column:
    """Exact sum of a float or double column, rounded once per value, as ``decimal(38, scale)``.

    Values below 2**51 in units of 10**-scale are cut into a whole part and two groups of at most
    five digits, which are summed as whole numbers, far from overflow for any number of rows (about 3.5
    times the cost of a sum of doubles, which depends on the layout). Larger ones are summed as decimals, rounded alike.
    """
    if not 5 <= scale <= 10:
        return F.sum(quantize(col, scale))
    x = _col(col).cast("double")
    near = F.abs(x) < F.lit(2.0 ** 51 / 10.0 ** scale)
    low_digits = scale - 5
    whole, digits = _split(x, scale)
    base = F.lit(10 ** low_digits)

    def total(part: Column, shift: int) -> Column:
        moved = F.sum(F.when(near, part)).cast("decimal(20,0)")
        return moved * F.lit(Decimal(1).scaleb(-shift)) if shift else moved

    far = F.sum(F.when(~near, quantize(col, scale)))
    result = T.DecimalType(38, scale)
    room = T.DecimalType(36, scale)
    close = total(whole, 0) + total(F.floor(digits / base), 5) + total(F.pmod(digits, base), scale)
    both = F.coalesce(close.cast(room), F.lit(0).cast(room)) + F.coalesce(far.cast(room), F.lit(0).cast(room))
    return F.when(close.isNotNull() | far.isNotNull(), both.cast(result))


def mean_of(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), n), F.lit(NAN))


def stable_mean(col, scale: int = 10) -> Column:
    """Exact sum over count; NaN when there is nothing to average."""
    return mean_of(exact_sum(col, scale), fit_count(col, scale))


LIMB = 10 ** 10
UNIT_SCALE = 10
WHOLE = T.DecimalType(38, 0)
VARIANCE_SUMS = ("sh", "sm", "sl", "shh", "shm", "shl", "smm", "sml", "sll")


def unit_limbs(col, scale: int = UNIT_SCALE) -> tuple[Column, Column, Column]:
    """The value as a whole number of 10**-10, high * 10**20 + middle * 10**10 + low, all of its sign; NULL where it does not fit.

    It is rounded to ``scale`` decimals, ten at most.
    """
    x = _col(col).cast("double")
    whole, digits = _split(F.abs(x), scale)
    step = F.lit(LIMB).cast("bigint")
    high = F.call_function("div", whole, step)
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))
    held = fits(x)
    limbs = high, whole - high * step, digits * F.lit(10 ** (UNIT_SCALE - scale))
    return tuple(F.when(held, limb * sign) for limb in limbs)


HALF_BITS = 17
PAIRS = ("hh", "hm", "hl", "mm", "ml", "ll")


def variance_terms(high: Column, middle: Column, low: Column) -> dict[str, Column]:
    """What has to be summed for a variance: bigints of at most 19 bits, so their sums hold for any number of rows below 2**44.

    Each limb is cut into halves of 17 bits, and each product of limbs into four digits of 17 bits, carries left in place.
    """
    mask = F.lit((1 << HALF_BITS) - 1).cast("bigint")

    def cut(x: Column) -> tuple[Column, Column]:
        return F.shiftright(x, HALF_BITS), x.bitwiseAND(mask)

    halves = {name: cut(limb) for name, limb in zip("hml", (high, middle, low))}
    terms = {f"s{name}{i}": half for name, pair in halves.items() for i, half in zip((1, 0), pair)}
    for a, b in PAIRS:
        (a1, a0), (b1, b0) = halves[a], halves[b]
        (low1, low0), (mid1, mid0), (top1, top0) = (cut(c) for c in (a0 * b0, a0 * b1 + a1 * b0, a1 * b1))
        terms |= {f"s{a}{b}0": low0, f"s{a}{b}1": low1 + mid0, f"s{a}{b}2": mid1 + top0, f"s{a}{b}3": top1}
    return terms


VARIANCE_TERMS = tuple(f"s{x}{i}" for x in "hml" for i in (1, 0)) + tuple(f"s{p}{i}" for p in PAIRS for i in range(4))


def variance_sums(totals: dict[str, Column]) -> dict[str, Column]:
    """The sums of limbs and of their products, put together from the summed terms."""
    def joined(name: str, digits: int) -> Column:
        parts = [totals[f"{name}{i}"].cast("decimal(19,0)") * F.lit(Decimal(1 << HALF_BITS * i)) for i in range(digits)]
        whole = parts[0]
        for part in parts[1:]:
            whole = (whole + part).cast(WHOLE)
        return whole

    return {f"s{x}": joined(f"s{x}", 2) for x in "hml"} | {f"s{p}": joined(f"s{p}", 4) for p in PAIRS}


def variance_of(n: Column, sums: dict[str, Column]) -> Column:
    """Sample variance from the count and the exact sums of the limbs and of their products.

    All is centred at a whole number near the mean, limb by limb, so nothing cancels and no sum
    grows beyond a decimal for any number of rows below 10**12. The limbs are put together from the highest down, as
    decimals as far as these hold, and then in double. One value, or none, gives 0.
    """
    def whole(c: Column) -> Column:
        return c.cast(WHOLE)

    def bound(values: dict[str, Column], use) -> Column:
        """``use`` of the values, each computed once."""
        return F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), use)[0]

    limb, base = F.lit(LIMB).cast("decimal(11,0)"), float(LIMB)

    def cut(x: Column, unit: float) -> Column:
        return F.signum(x) * F.floor(F.abs(x) / F.lit(unit))

    def centred(t: Column) -> Column:
        mean = F.try_divide(t["sh"].cast("double") * F.lit(base ** 2) + t["sm"].cast("double") * F.lit(base) + t["sl"].cast("double"), t["n"])
        return bound({"mean": mean}, lambda x: bound({"below": x["mean"] - cut(x["mean"], base ** 2) * F.lit(base ** 2)}, lambda y: bound(
            {"h": cut(x["mean"], base ** 2).cast("decimal(13,0)"), "m": cut(y["below"], base).cast("decimal(13,0)"),
             "l": F.round(y["below"] - cut(y["below"], base) * F.lit(base)).cast("decimal(13,0)")}, lambda c: parts_of(t, c))))

    def parts_of(t: Column, c: Column) -> Column:
        count = t["n"].cast("decimal(13,0)")

        def product(x: str, y: str) -> Column:
            crossed = whole(whole(t["s" + x] * c[y]) + whole(t["s" + y] * c[x]))
            return whole(whole(t["s" + x + y] - crossed) + whole(whole(count * c[x]) * c[y]))

        def twice(part: Column) -> Column:
            return whole(part * F.lit(2))

        rests = [whole(t["s" + k] - whole(count * c[k])) for k in "hml"]
        rest = whole(whole(whole(whole(rests[0] * limb) + rests[1]) * limb) + rests[2]).cast("double")
        return bound({"p0": product("h", "h"), "p1": twice(product("h", "m")), "p2": whole(twice(product("h", "l")) + product("m", "m")),
                      "p3": twice(product("m", "l")), "p4": product("l", "l"), "rest": rest}, lambda p: spread(p, t["n"]))

    def spread(p: Column, rows: Column) -> Column:
        exact = [p["p0"]]
        for k in range(1, 5):
            exact.append(whole(F.try_add(whole(F.try_multiply(exact[-1], limb)), p[f"p{k}"])))
        # The lowest exact one, then the parts below it.
        ways = []
        for held in (4, 3, 2, 1, 0):
            way = exact[held].cast("double")
            for k in range(held + 1, 5):
                way = way * F.lit(base) + p[f"p{k}"].cast("double")
            ways.append(way)
        return F.coalesce(*ways) - p["rest"] * p["rest"] / rows

    total = {k: F.coalesce(whole(sums[k]), F.lit(0).cast(WHOLE)) for k in VARIANCE_SUMS}
    squares = bound(total | {"n": n}, centred)
    return F.when(n > 1, F.greatest(squares, F.lit(0.0)) / (n - 1) / F.lit(10.0 ** (2 * UNIT_SCALE))).otherwise(F.lit(0.0))


def stable_variance(col, scale: int = UNIT_SCALE) -> Column:
    """Sample variance in one pass from exact sums, of the same values that ``exact_sum`` adds."""
    return limb_variance(*unit_limbs(col, scale))


def limb_variance(high: Column, middle: Column, low: Column) -> Column:
    """The same from ``unit_limbs`` that were computed before, once for all terms."""
    return variance_of(F.count(low), variance_sums({k: F.sum(v) for k, v in variance_terms(high, middle, low).items()}))


def all_finite(*cols) -> Column:
    """True when every given value of every row is a number; True for no rows."""
    gate = is_finite(cols[0])
    for c in cols[1:]:
        gate = gate & is_finite(c)
    return F.coalesce(F.bool_and(gate), F.lit(True))


def positive_sum(col, scale: int = 10) -> Column:
    return F.coalesce(exact_sum(F.greatest(F.lit(0.0), _col(col).cast("double")), scale),
                      F.lit(0).cast(T.DecimalType(38, scale)))
