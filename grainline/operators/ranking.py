"""Exact global positions and quantiles without a single-partition window
and without moving hot values into one task.

Range bounds never split equal keys, so equal values are counted first
(``groupBy(...).count()``, combined map-side): what is range-partitioned are
distinct values with their counts.  The ranges are written with their number;
running counts inside a range and the sums of the ranges before it (one row
per range) give every value's position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.session import materialize


def running_count(df: DataFrame, order: Sequence[Column], weight: str, before: str = "_before") -> DataFrame:
    """Add ``before`` = sum of ``weight`` over all rows that come earlier in
    ``order``, which must be total (no two rows equal in it)."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row per range: bounded by the partition count, not by the data
    sums = ranged.groupBy("_range").agg(F.sum(weight).alias("_s"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).cast("long").alias("_off"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn(before, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .join(F.broadcast(offsets), "_range")
            .withColumn(before, (F.col(before) + F.col("_off")).cast("long")).drop("_range", "_off"))


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "_rank") -> DataFrame:
    """Add a 0-based ``rank_col`` = position of the row in ``order``, which
    must be total; rows that are equal in it would share one task."""
    return running_count(df.withColumn("_one", F.lit(1)), order, "_one", rank_col).drop("_one")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles (``percentile`` / ``quantile_cont``)
    of non-null ``col`` per ``by`` group, without collecting any group.

    Returns one row per group with columns ``q0, q1, ...`` for ``probs``.
    Values are counted first, so ties cost one row; a value answers the
    wanted positions that fall into its run.
    """
    by = list(by)
    keys = [f"_b{i}" for i in range(len(by))]
    counts = (df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(col).cast("double").alias("_v"))
              .where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    order = [F.col(k).asc_nulls_last() for k in keys] + [F.col("_v").asc()]
    runs = materialize(running_count(counts, order, "_c"), "runs")
    groups = runs.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_before").alias("_s"))
    if keys:
        g = groups.withColumnsRenamed({k: f"_g{k}" for k in keys})
        cond = None
        for k in keys:
            e = runs[k].eqNullSafe(g[f"_g{k}"])
            cond = e if cond is None else cond & e
        rows = runs.join(g, cond).drop(*[f"_g{k}" for k in keys])
    else:
        one = groups.first()
        rows = runs.withColumns({"_n": F.lit(one["_n"]).cast("long"), "_s": F.lit(one["_s"]).cast("long")})
    at = F.col("_before") - F.col("_s")
    found, out = [], []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("_n") - 1)
        for name, r in (("lo", lo), ("hi", hi)):
            found.append(F.max(F.when((at <= r) & (r < at + F.col("_c")), F.col("_v"))).alias(f"_{name}{i}"))
        found.append(F.max(h - lo).alias(f"_f{i}"))
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}"))
    return rows.groupBy(*keys).agg(*found).select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *out)
