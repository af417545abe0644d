"""Date expressions: parsing, calendar parts, day differences, ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

# Day-first text formats tried in order (the reference parses dates with
# "day first").  Fixed values.
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy")

# Proleptic Gregorian ordinal of 0001-01-01 is 1; 1970-01-01 is 719163.
_EPOCH_ORDINAL = 719163


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_day(c: str | Column) -> Column:
    """Timestamp / timestamp_ntz / date -> DATE."""
    return F.to_date(_c(c))


def parse_dates(df: DataFrame, cols: Sequence[str], formats: Sequence[str] = DAY_FIRST_FORMATS,
                strict: bool = False) -> DataFrame:
    """Parse day-first text dates in ``cols`` to DATE.

    Text that matches none of ``formats`` becomes NULL.  With
    ``strict=True`` such text raises instead (``to_date`` under ANSI mode),
    which is what the reference's parser does.  Columns that already hold
    dates or timestamps are only truncated to a DATE.
    """
    types = dict(df.dtypes)
    out = {}
    for name in cols:
        dtype = types[name]
        col = F.col(name)
        if dtype in ("date",):
            out[name] = col
        elif dtype.startswith("timestamp"):
            out[name] = F.to_date(col)
        else:
            txt = F.trim(col.cast(StringType()))
            tries = [F.try_to_date(txt, fmt) for fmt in formats]
            parsed = F.coalesce(*tries) if len(tries) > 1 else tries[0]
            if strict:
                parsed = F.when(txt.isNull() | (txt == ""), F.lit(None).cast(DateType())) \
                    .otherwise(F.coalesce(parsed, F.to_date(txt, formats[0])))
            out[name] = parsed
    return df.withColumns(out)


def calendar_part_columns(prefix: str) -> list[str]:
    return [f"{prefix}_year", f"{prefix}_month", f"{prefix}_week", f"{prefix}_wday"]


def calendar_parts(date: str | Column, prefix: str) -> dict[str, Column]:
    """Year, month, ISO week and weekday (Monday = 0) of a date.

    ``year`` is the calendar year even where the ISO week belongs to the
    next year (2018-12-31 is week 1 of year 2018), as in pandas.
    """
    d = _c(date)
    y, m, w, wd = calendar_part_columns(prefix)
    return {
        y: F.year(d),
        m: F.month(d),
        w: F.weekofyear(d),
        wd: F.weekday(d),
    }


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole days ``later - earlier`` (INT, NULL if either is NULL)."""
    return F.datediff(_c(later), _c(earlier))


def day_ordinal(date: str | Column) -> Column:
    """Proleptic Gregorian day number with 0001-01-01 = 1 (INT)."""
    return (F.unix_date(_c(date)) + F.lit(_EPOCH_ORDINAL)).cast("int")
