"""Exploratory reports: distributions, per-entity visit counts, key overlap,
missing values and train/test category frequencies.  Each reads its input
once (distributions twice) and collects nothing but single summary rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.operators.ranking import exact_quantiles
from grainline.session import materialize

QUARTILES = (0.25, 0.5, 0.75)


def describe_by(df: DataFrame, col: str, by: Sequence[str] = (),
                probs: Sequence[float] = QUARTILES, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quantiles, max of ``col`` per group.

    ``exact=True`` takes quantiles from counted values (no group is
    collected); ``exact=False`` takes values of the column whose rank is off by
    at most ``sketch_error()`` of the group, from a mergeable sketch (one pass)."""
    by = list(by)
    base = df.groupBy(*by).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    names = [f"p{int(round(p * 100))}" for p in probs]
    if exact:
        q = exact_quantiles(df, col, probs, by)
        q = q.withColumnsRenamed({f"q{i}": n for i, n in enumerate(names)})
        if by:
            return _join_null_safe(base, q, by)
        return _with_scalars(base, q)
    approx = sketch_quantiles(quantile_sketch(df, col, by), probs, by, names)
    if by:
        return _join_null_safe(base, approx, by)
    return _with_scalars(base, approx)


#: Items that a level of a quantile sketch holds.
SKETCH_ITEMS = 400


def sketch_error(items: int = SKETCH_ITEMS) -> float:
    """Rank error of a sketch as a share of its rows, with 99% confidence
    (the published fit for KLL sketches)."""
    return 2.296 / items ** 0.9723


def quantile_sketch(df: DataFrame, col: str, by: Sequence[str] = (), items: int = SKETCH_ITEMS) -> DataFrame:
    """``by`` columns and ``sketch``: a KLL sketch of the values that are
    neither NULL nor NaN.  Sketches are built map-side, some kilobytes each, may
    be stored, and add up (``merge_sketches``)."""
    x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double("_x", F.lit(items)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), items: int = SKETCH_ITEMS) -> DataFrame:
    """One sketch per ``by`` group of stored sketches (days to months, say)."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(items)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float] = QUARTILES, by: Sequence[str] = (),
                     names: Sequence[str] | None = None) -> DataFrame:
    """``by`` columns and one column per quantile read off the sketches."""
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    return sketches.select(*by, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for p, n in zip(probs, names)])


def _with_scalars(base: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global (single-row) aggregate as literals."""
    row = one_row.first()
    vals = row.asDict() if row is not None else {c: None for c in one_row.columns}
    types = dict(one_row.dtypes)
    return base.withColumns({c: F.lit(v).cast(types[c]) for c, v in vals.items()})


def _join_null_safe(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on group keys where a NULL key is a group of its own."""
    r = right.withColumnsRenamed({b: f"_r_{b}" for b in by})
    cond = [left[b].eqNullSafe(r[f"_r_{b}"]) for b in by]
    return left.join(r, cond, "left").drop(*[f"_r_{b}" for b in by])


def visits_per_entity(df: DataFrame, entity: str, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Distribution of the number of rows per entity (how many visits a
    member has); the reference chose its lag depth from this."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("visits"))
    return describe_by(per, "visits", (), probs)


def key_overlap(df: DataFrame, key: str, side: str) -> DataFrame:
    """Counts of distinct keys only on the left (``side`` = 1), only on the
    right (0) and on both; one scan, one row per key and task is shuffled."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max((F.col(side) == 1).cast("int")).alias("_a"), F.max((F.col(side) == 0).cast("int")).alias("_b"))
    count = lambda a, b: F.coalesce(F.sum(((F.col("_a") == a) & (F.col("_b") == b)).cast("long")), F.lit(0).cast("long"))
    return per.agg(count(1, 0).alias("only_left"), count(0, 1).alias("only_right"), count(1, 1).alias("both"))


def profile_nulls(df: DataFrame, cols: Sequence[str] | None = None,
                  with_types: bool = True) -> DataFrame:
    """One row per column: type, rows, nulls, null share.  One pass over
    the data (a single global aggregate), then ``unpivot`` of that row."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = agg.unpivot("__rows", cols, "column_name", "nulls")
    tmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return long.select(
        "column_name",
        *([tmap[F.col("column_name")].alias("dtype")] if with_types else []),
        F.col("__rows").alias("rows"),
        F.col("nulls").cast("long").alias("nulls"),
        F.try_divide(F.col("nulls").cast("double"), F.col("__rows").cast("double")).alias("null_share"),
    )


def profile_schema(df: DataFrame) -> DataFrame:
    """The schema as a small DataFrame (column, dtype, nullable, position)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, nullable boolean, position int")


def frequency_compare(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """For every (column, value): rows with ``by`` = 1 and = 0, and each
    count's share of its side.  One scan: each row is unpivoted to its
    (column, value as text) pairs, which are counted map-side, and the totals
    come from that written table of one row per (column, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.col(by).alias("_s"), F.explode(pairs).alias("_e")).select("_s", "_e.attribute", "_e.value")
    wide = materialize(long.groupBy("attribute", "value").agg(
        F.sum((F.col("_s") == 1).cast("long")).alias("n_train"), F.sum((F.col("_s") == 0).cast("long")).alias("n_test")), "freq")
    totals = wide.groupBy("attribute").agg(F.sum("n_train").alias("_tt"), F.sum("n_test").alias("_te"))
    return (wide.join(F.broadcast(totals), "attribute")  # one row per column
            .withColumn("share_train", F.try_divide(F.col("n_train").cast("double"), F.col("_tt").cast("double")))
            .withColumn("share_test", F.try_divide(F.col("n_test").cast("double"), F.col("_te").cast("double")))
            .drop("_tt", "_te"))
