"""Scalar column expressions. All are built-in Spark SQL functions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from grainline.functions.dates import (
    calendar_parts,
    calendar_part_columns,
    day_ordinal,
    days_between,
    parse_dates,
    to_day,
)
from grainline.functions.numeric import (
    ratio,
    round_even,
    zero_of,
)

__all__ = [
    "calendar_parts",
    "calendar_part_columns",
    "day_ordinal",
    "days_between",
    "parse_dates",
    "to_day",
    "ratio",
    "round_even",
    "zero_of",
]
