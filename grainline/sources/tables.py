"""Reservations derived from the TPC-H-like test tables.

One reservation per order.  Every column is computed by Spark from
``orders``, ``customer``, ``nation`` and a per-order aggregate of
``lineitem``, so the work grows with the tables.  The mapping is fixed and
documented in FIXTURES.md; ``grainline.oracle.BOOKINGS_SQL`` is the same
mapping written for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from grainline.operators.dealing import dealt_join
from grainline.session import partitions_for

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Market segment whose customers form the "test" reservations (members of
# train and test never overlap, as in the reference's data).  Fixed value.
TEST_SEGMENT = "HOUSEHOLD"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_lines(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Per-order aggregate of lineitem, its five narrow columns dealt by order
    into ``parts`` partitions."""
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", "l_returnflag", "l_suppkey")
    return li.where(F.col("l_orderkey").isNotNull()).repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min(F.to_date("l_shipdate")).alias("first_ship"),
        F.max(F.to_date("l_shipdate")).alias("last_ship"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
        F.min("l_suppkey").alias("supp"),
    )


def bookings_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reservations (train and test) with a ``is_test`` flag column."""
    o = load_table(spark, sf_dir, "orders")
    c = load_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation has one row per nation: a fixed-size dimension, safe to broadcast.
    n = F.broadcast(load_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    # tasks hold about as many orders whatever the session's shuffle partitions
    parts = partitions_for(o)
    li = _order_lines(spark, sf_dir, parts)

    j = (dealt_join(o, c.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], parts)
         .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
         .repartition(parts, "o_orderkey")
         .join(li, F.col("o_orderkey") == li.l_orderkey, "left"))

    prio = F.substring("o_orderpriority", 1, 1).cast(IntegerType())
    adults = F.ceil(F.col("qty") / F.col("n_lines") / F.lit(10.0)).cast(IntegerType())
    children = F.col("n_ret").cast(IntegerType())
    supp = F.col("supp")
    return j.select(
        F.col("o_orderkey").alias("reservation_id"),
        F.to_date("o_orderdate").alias("booking_date"),
        F.col("first_ship").alias("checkin_date"),
        F.date_add("last_ship", 1).alias("checkout_date"),
        prio.alias("channel_code"),
        (F.pmod(F.col("c_nationkey"), F.lit(7)) + 1).cast(IntegerType()).alias("main_product_code"),
        adults.alias("numberofadults"),
        children.alias("numberofchildren"),
        (F.lit(45) + F.pmod(F.col("qty").cast("bigint"), F.lit(4))).cast(IntegerType())
        .alias("persontravellingid"),
        (F.pmod(supp, F.lit(3)) + 1).cast(IntegerType()).alias("resort_region_code"),
        F.pmod(supp, F.lit(7)).cast(IntegerType()).alias("resort_type_code"),
        F.least(F.col("n_lines"), F.lit(6)).cast(IntegerType()).alias("room_type_booked_code"),
        (F.col("n_lines") - 2).cast(IntegerType()).alias("roomnights"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast(DoubleType()))
        .otherwise(prio.cast(DoubleType())
                   + F.when(F.pmod(F.col("n_ret"), F.lit(2)) == 1, 0.5).otherwise(0.0))
        .alias("season_holidayed_code"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast(DoubleType()))
        .otherwise(F.col("c_nationkey").cast(DoubleType())).alias("state_code_residence"),
        (F.pmod(supp, F.lit(11)) + 1).cast(IntegerType()).alias("state_code_resort"),
        (adults + children).alias("total_pax"),
        F.col("c_mktsegment").alias("member_age_buckets"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).cast(IntegerType())
        .alias("booking_type_code"),
        F.col("o_custkey").alias("memberid"),
        F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("cluster_code"),
        F.col("o_orderstatus").alias("reservationstatusid_code"),
        F.concat(F.lit("R"), supp.cast("string")).alias("resort_id"),
        F.when(F.col("c_mktsegment") == TEST_SEGMENT, F.lit(None).cast(DoubleType()))
        .otherwise(F.coalesce(F.col("qty"), F.lit(0.0)) / F.lit(20.0)
                   + F.col("o_totalprice") / F.lit(500000.0))
        .alias("amount_spent_per_room_night_scaled"),
        (F.col("c_mktsegment") == TEST_SEGMENT).alias("is_test"),
    )


def bookings_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) reservations, the two inputs the feature job unions."""
    b = bookings_from_tables(spark, sf_dir)
    train = b.where(~F.col("is_test")).drop("is_test")
    test = b.where(F.col("is_test")).drop("is_test", "amount_spent_per_room_night_scaled")
    return train, test


def tagged_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reservations once, with the source flag (1 train, 0 test): what
    the union of ``bookings_pair`` holds, without building the joins twice."""
    b = bookings_from_tables(spark, sf_dir)
    return b.withColumn("train_set", F.when(F.col("is_test"), 0).otherwise(1)).drop("is_test")
