"""Numeric, conditional and missing-value functions. The row statistics ignore missing arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.missing import col, divide, missing_number, missing_text


def abs_(x) -> Column:
    return F.abs(col(x))


def ceil(x) -> Column:
    return F.ceil(col(x)).cast("double")


def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


def round_(x, unit=1) -> Column:
    """Rounds half away from zero to a multiple of the unit."""
    if isinstance(unit, (int, float)) and unit in (1, 0.1, 0.01, 0.001, 0.0001):
        return F.round(col(x).cast("double"), {1: 0, 0.1: 1, 0.01: 2, 0.001: 3, 0.0001: 4}[unit])
    return F.round(col(x).cast("double") / col(unit), 0) * col(unit)


def mod(x, y) -> Column:
    """The remainder with the sign of the dividend; missing for a zero divisor."""
    return F.try_mod(col(x).cast("double"), F.nullif(col(y).cast("double"), F.lit(0.0)))


def int_(x) -> Column:
    x = col(x).cast("double")
    return F.signum(x) * F.floor(F.abs(x))


def sign(x) -> Column:
    return F.signum(col(x).cast("double"))


def sqrt(x) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def log(x) -> Column:
    return F.when(col(x) > 0, F.log(col(x)))


def log10(x) -> Column:
    return F.when(col(x) > 0, F.log10(col(x)))


def exp(x) -> Column:
    return F.exp(col(x))


def max_(*xs) -> Column:
    return F.greatest(*map(col, xs)) if len(xs) > 1 else col(xs[0])


def min_(*xs) -> Column:
    return F.least(*map(col, xs)) if len(xs) > 1 else col(xs[0])


def n(*xs) -> Column:
    return reduce(Column.__add__, [F.when(missing_number(x), 0).otherwise(1) for x in xs])


def nmiss(*xs) -> Column:
    return reduce(Column.__add__, [F.when(missing_number(x), 1).otherwise(0) for x in xs])


def cmiss(*xs) -> Column:
    """Missing arguments of either type."""
    return reduce(Column.__add__, [F.when(missing_text(col(x).cast("string")), 1).otherwise(0) for x in xs])


def sum_(*xs) -> Column:
    total = reduce(Column.__add__, [F.coalesce(col(x).cast("double"), F.lit(0.0)) for x in xs])
    return F.when(n(*xs) > 0, total)


def mean(*xs) -> Column:
    return divide(sum_(*xs), n(*xs))


def range_(*xs) -> Column:
    return max_(*xs) - min_(*xs)


def uss(*xs) -> Column:
    return sum_(*[col(x).cast("double") * col(x) for x in xs])


def css(*xs) -> Column:
    m = mean(*xs)
    return sum_(*[(col(x) - m) * (col(x) - m) for x in xs])


def std(*xs) -> Column:
    return F.sqrt(divide(css(*xs), F.nullif(n(*xs) - 1, F.lit(0))))


def coalesce(*xs) -> Column:
    return F.coalesce(*map(col, xs))


def coalescec(*xs) -> Column:
    return F.coalesce(*[F.when(~missing_text(x), col(x)) for x in xs])


def ifn(cond: Column, yes, no, miss=None) -> Column:
    """Three or four arguments; without the fourth a missing condition is false."""
    out = F.when(F.coalesce(cond.cast("boolean"), F.lit(False)), col(yes)).otherwise(col(no))
    return out if miss is None else F.when(cond.isNull(), col(miss)).otherwise(out)


ifc = ifn


def missing(x) -> Column:
    """1 for a missing value of either type."""
    return F.when(missing_text(col(x).cast("string")) | F.coalesce(col(x).cast("string") == "NaN", F.lit(False)), 1).otherwise(0)
