"""Numeric expressions with the reference's rounding and null rules."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    StringType,
    TimestampNTZType,
    TimestampType,
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals (numpy / pandas rounding).

    ``rint(x * 10^d) / 10^d`` matches numpy bit for bit; ``bround`` works on
    the decimal expansion and disagrees on values such as 23/40.
    """
    x = _c(c).cast(DoubleType())
    if digits == 0:
        return F.rint(x)
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def ratio(num: str | Column, den: str | Column, digits: int | None = 2) -> Column:
    """``num / den`` rounded half-even; a zero denominator gives NULL
    (ANSI-safe ``try_divide``) instead of an infinity."""
    q = F.try_divide(_c(num).cast(DoubleType()), _c(den).cast(DoubleType()))
    return q if digits is None else round_even(q, digits)


def zero_of(dtype: DataType) -> Column:
    """The value a masked "set to 0" assignment leaves in a column."""
    if isinstance(dtype, (IntegralType, FloatType, DoubleType, DecimalType)):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, BooleanType):
        return F.lit(False)
    if isinstance(dtype, StringType):
        return F.lit("0")
    if isinstance(dtype, DateType):
        return F.lit(_dt.date(1970, 1, 1))
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.lit(_dt.datetime(1970, 1, 1)).cast(dtype)
    return F.lit(None).cast(dtype)
