"""Missing values: NULL (and NaN) for numbers, NULL or blank for text; a missing number is less than every number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column from a column, or a literal from anything else."""
    return x if isinstance(x, Column) else F.lit(x)


def missing_number(x) -> Column:
    return col(x).isNull() | F.isnan(col(x).cast("double"))


def missing_text(x) -> Column:
    return col(x).isNull() | (F.trim(col(x)) == "")


def blank_to_null(x) -> Column:
    return F.when(F.trim(col(x)) == "", F.lit(None).cast("string")).otherwise(col(x))


def less(x, y) -> Column:
    return F.coalesce(col(x) < col(y), col(x).isNull() & col(y).isNotNull())


def less_equal(x, y) -> Column:
    return F.coalesce(col(x) <= col(y), col(x).isNull())


def greater(x, y) -> Column:
    return less(y, x)


def greater_equal(x, y) -> Column:
    return less_equal(y, x)


def equal(x, y) -> Column:
    return col(x).eqNullSafe(col(y))


def not_equal(x, y) -> Column:
    return ~col(x).eqNullSafe(col(y))


def number(pred: Column) -> Column:
    """A condition as 0 or 1; unknown counts as false."""
    return F.coalesce(pred.cast("int"), F.lit(0))


def divide(x, y) -> Column:
    """Division that gives missing for a zero divisor."""
    return F.try_divide(col(x).cast("double"), col(y).cast("double"))


def to_number(x) -> Column:
    """Text as a number, missing where it is none."""
    return col(x).try_cast("double")
