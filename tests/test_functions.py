"""Scalar rules N6-N10 with hand-written expected values."""
import datetime as dt

from pyspark.sql import functions as F

from grainline.functions import calendar_parts, day_ordinal, days_between, parse_dates, ratio, round_even


def test_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.125,), (-2.5,), (None,)], "x double")
    got = [r[0] for r in df.select(round_even("x", 0).alias("a")).collect()]
    assert got == [2.0, 4.0, 0.0, -2.0, None]
    got2 = [r[0] for r in df.select(round_even("x", 2).alias("a")).collect()]
    assert got2[2] == 0.12


def test_ratio_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (23, 40), (2, 3)], "a int, b int")
    got = [r[0] for r in df.select(ratio("a", "b").alias("r")).collect()]
    assert got == [None, None, 0.57, 0.67]  # 23/40 = 0.575 -> 0.57 (half-even on binary value)


def test_calendar_parts_iso_week_and_monday_zero(spark):
    df = spark.createDataFrame([(dt.date(2018, 12, 31),), (dt.date(2021, 1, 3),)], "d date")
    row = df.select(*[c.alias(n) for n, c in calendar_parts("d", "x").items()]).collect()
    assert tuple(row[0]) == (2018, 12, 1, 0)     # Monday, ISO week 1, calendar year 2018
    assert tuple(row[1]) == (2021, 1, 53, 6)     # Sunday


def test_ordinal_and_days_between(spark):
    df = spark.createDataFrame([(dt.date(1, 1, 1), dt.date(1970, 1, 1)),
                                (dt.date(2019, 3, 1), dt.date(2019, 2, 27)),
                                (None, dt.date(2019, 2, 27))], "a date, b date")
    got = df.select(day_ordinal("a").alias("o"), day_ordinal("b").alias("ob"),
                    days_between("a", "b").alias("d")).collect()
    assert got[0]["o"] == 1 and got[0]["ob"] == dt.date(1970, 1, 1).toordinal()
    assert got[1]["o"] == dt.date(2019, 3, 1).toordinal() and got[1]["d"] == 2
    assert got[2]["o"] is None and got[2]["d"] is None


def test_parse_day_first(spark):
    df = spark.createDataFrame([("3/10/2018",), ("03-10-2018",), ("31/12/18",), ("junk",), (None,)],
                               "t string")
    got = [r[0] for r in parse_dates(df, ["t"]).collect()]
    assert got == [dt.date(2018, 10, 3), dt.date(2018, 10, 3), dt.date(2018, 12, 31), None, None]
