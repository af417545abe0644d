"""Connected components of an edge table by alternating star contractions.

Every step is a grouped minimum (combined map-side, so a hub costs one row
per task) and a join on the hub id that AQE may split.  Nothing goes through
the driver but two counters per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.session import materialize


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """One contraction.  ``directed``: (u, v) with v < u, no repeats."""
    if large:
        both = directed.union(directed.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = directed.groupBy("u").agg(F.min("v").alias("m"))
        out = directed.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, label: str = "cc") -> DataFrame:
    """(node, root) for every node with at least one edge; root is the
    smallest node of its component.  NULL ends and self loops are ignored;
    an empty edge table gives an empty result."""
    e = (edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = materialize(e, label)
    before = _signature(e)
    while before[0]:
        e = materialize(_star(_star(e, True), False), label)
        after = _signature(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
