"""Reservation ("bookings") input: CSV by header name, or Parquet."""

from __future__ import annotations

import concurrent.futures as cf
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from grainline.functions.dates import DAY_FIRST_FORMATS, parse_dates

ID_COL = "reservation_id"
TARGET_COL = "amount_spent_per_room_night_scaled"
MEMBER_COL = "memberid"
DATE_COLS = ("booking_date", "checkin_date", "checkout_date")

# Column names of the reservation files (the data's own header).  Fixed values.
BOOKING_SCHEMA = StructType([
    StructField("reservation_id", StringType()),
    StructField("booking_date", StringType()),
    StructField("checkin_date", StringType()),
    StructField("checkout_date", StringType()),
    StructField("channel_code", IntegerType()),
    StructField("main_product_code", IntegerType()),
    StructField("numberofadults", IntegerType()),
    StructField("numberofchildren", IntegerType()),
    StructField("persontravellingid", IntegerType()),
    StructField("resort_region_code", IntegerType()),
    StructField("resort_type_code", IntegerType()),
    StructField("room_type_booked_code", IntegerType()),
    StructField("roomnights", IntegerType()),
    StructField("season_holidayed_code", DoubleType()),
    StructField("state_code_residence", DoubleType()),
    StructField("state_code_resort", IntegerType()),
    StructField("total_pax", IntegerType()),
    StructField("member_age_buckets", StringType()),
    StructField("booking_type_code", IntegerType()),
    StructField("memberid", StringType()),
    StructField("cluster_code", StringType()),
    StructField("reservationstatusid_code", StringType()),
    StructField("resort_id", StringType()),
    StructField("amount_spent_per_room_night_scaled", DoubleType()),
])

RAW_COLUMNS = [f.name for f in BOOKING_SCHEMA.fields]


def _read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _files_by_header(spark: SparkSession, path: str, parallelism: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` by their header.  A file's header is one job that
    reads its first line; the file names, not the rows, go through the driver."""
    files = sorted(_read_csv(spark, path).inputFiles())
    with cf.ThreadPoolExecutor(max_workers=parallelism) as pool:
        headers = list(pool.map(lambda f: tuple(_read_csv(spark, f).columns), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for f, h in zip(files, headers):
        if h:  # a file without a header line has no rows
            out.setdefault(h, []).append(f)
    return out or {(): [path]}


def _typed(raw: DataFrame, schema: StructType, strict: bool, bad_col: str | None) -> DataFrame:
    """Text columns of ``raw`` as the schema's types, NULL where absent."""
    unknown = [c for c in raw.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"columns that the schema lacks: {unknown}")
    text = {c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in raw.columns}
    cols, bad = [], F.lit(0)
    for f in schema.fields:
        if f.name not in text:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        kind = f.dataType.simpleString()
        cast = text[f.name].cast(kind) if strict else text[f.name].try_cast(kind)
        cols.append(cast.alias(f.name))
        bad = bad + (text[f.name].isNotNull() & text[f.name].try_cast(kind).isNull()).cast("int")
    return raw.select(*cols, *([bad.alias(bad_col)] if bad_col else []))


def read_bookings(spark: SparkSession, path: str, fmt: str = "csv",
                  schema: StructType = BOOKING_SCHEMA, date_formats=DAY_FIRST_FORMATS,
                  strict_dates: bool = False, strict: bool = False,
                  bad_col: str | None = None) -> DataFrame:
    """Read reservation files and parse the three day-first dates.

    CSV columns are taken by the header names of each file, in any order (only
    headers are read first; no inference pass over the data): files with equal
    headers are one scan, and scans are united by name.  Columns of the schema
    that a file lacks are NULL (a test file has no target), others are an error.
    Fields are read as text and cast; text that is no value of its column's
    type becomes NULL and is counted per row in ``bad_col`` if that is given,
    or raises with ``strict=True``.
    """
    if fmt == "csv":
        parts = [_typed(_read_csv(spark, files), schema, strict, bad_col) for files in _files_by_header(spark, path).values()]
        df = reduce(DataFrame.unionByName, parts)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return parse_dates(df, list(DATE_COLS), date_formats, strict=strict_dates)
