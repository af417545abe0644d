"""Group-wise K folds and the metrics / ensembling around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.operators.ranking import global_rank
from grainline.session import materialize

FOLD_COL = "fold"


def fold_of(group: str | Column, k: int, seed: int = 2017) -> Column:
    """Fold number in [0, k) from a hash of (seed, group): every row of a
    group lands in the same fold, no shuffle and no driver-side member list.
    Same value in DuckDB:
    ``('0x' || substr(md5(seed || ':' || g), 1, 8))::BIGINT % k``."""
    g = F.col(group) if isinstance(group, str) else group
    h = F.md5(F.concat(F.lit(f"{seed}:"), g.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def group_kfold(df: DataFrame, group: str, k: int = 10, seed: int = 2017,
                fold_col: str = FOLD_COL) -> DataFrame:
    """Add ``fold_col``; a NULL group gets fold NULL (never validated)."""
    return df.withColumn(fold_col, F.when(F.col(group).isNotNull(), fold_of(group, k, seed)))


def even_folds(df: DataFrame, group: str, k: int = 10, seed: int = 2017,
               fold_col: str = FOLD_COL) -> DataFrame:
    """Add ``fold_col``: the distinct groups are dealt to the folds in turn, in
    the order of a hash of (seed, group), so numbers of groups differ by at most
    one (a NULL group gets fold NULL).  Positions come from range-partitioned
    running counts; rows get their group's fold by a join."""
    groups = (df.select(F.col(group).alias("_g")).where(F.col(group).isNotNull()).distinct()
              .withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_g").cast("string")))))
    dealt = global_rank(groups, [F.col("_h"), F.col("_g")], "_r").select("_g", F.pmod("_r", F.lit(k)).cast("int").alias(fold_col))
    return df.join(dealt, F.col(group) == F.col("_g"), "left").drop("_g")


def fold_split(df: DataFrame, fold: int, fold_col: str = FOLD_COL) -> tuple[DataFrame, DataFrame]:
    """(dev, val) rows for one fold: a filter, no join against a member list."""
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)


def fold_members(df: DataFrame, group: str, fold_col: str = FOLD_COL) -> DataFrame:
    """Distinct (group, fold) pairs."""
    return df.select(group, fold_col).distinct()


def rmse(df: DataFrame, y: str, p: str, by: Sequence[str] = (), name: str = "rmse") -> DataFrame:
    """Root mean squared error, overall or per ``by`` group."""
    e = F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))).alias(name)
    return df.groupBy(*by).agg(e, F.count(F.lit(1)).alias("n_rows"))


def cv_report(df: DataFrame, y: str, p: str, fold_col: str = FOLD_COL) -> DataFrame:
    """Per-fold RMSE and row count plus the mean of fold scores and the
    pooled RMSE, as rows ``(fold, rmse, n_rows, mean_fold_rmse,
    overall_rmse)``.  The scored rows are read once: squared errors are summed
    per fold, and the summary numbers come from that table of one row per
    fold."""
    per = materialize(df.groupBy(fold_col).agg(F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("_sq"),
                                               F.count(F.lit(1)).alias("n_rows")), "folds")
    per = per.withColumn("rmse", F.sqrt(F.try_divide("_sq", "n_rows")))
    total = per.agg(F.avg("rmse").alias("m"), F.sqrt(F.try_divide(F.sum("_sq"), F.sum("n_rows"))).alias("o")).first()
    return per.drop("_sq").withColumns({"mean_fold_rmse": F.lit(total["m"]).cast("double"),
                                        "overall_rmse": F.lit(total["o"]).cast("double")})


def average_predictions(preds: DataFrame, id_col: str, pred_col: str = "prediction",
                        name: str = "prediction") -> DataFrame:
    """Mean of several models' predictions per id (long format input)."""
    return preds.groupBy(id_col).agg(F.avg(pred_col).alias(name), F.count(pred_col).alias("n_models"))


def mean_of_columns(df: DataFrame, cols: Sequence[str], name: str = "prediction",
                    count_name: str = "n_models") -> DataFrame:
    """Mean of the non-null ``cols`` of each row, in one projection, and how
    many there were (k models' predictions side by side need no shuffle)."""
    known = [F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(F.lit(0.0)) for c in cols]
    n = [F.col(c).isNotNull().cast("long") for c in cols]
    count, total = n[0], known[0]
    for c, t in zip(n[1:], known[1:]):
        count, total = count + c, total + t
    return df.withColumns({count_name: count, name: F.try_divide(total, count.cast("double"))})


def percent_of_total(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """``100 * col / sum(col)``; the total is one number computed by a
    global aggregate, so no row travels to a single task."""
    total = df.agg(F.sum(col)).first()[0]
    val = F.try_divide(F.col(col).cast("double") * F.lit(100.0), F.lit(total).cast("double"))
    return df.withColumn(name or f"{col}_pct", val)


def top_k(df: DataFrame, col: str, k: int = 25, tie: Sequence[str] = ()) -> DataFrame:
    """Largest ``k`` rows by ``col``, equal ones by the ``tie`` columns
    (TakeOrderedAndProject: each task keeps its own top k; the limit is the
    feature)."""
    return df.orderBy(F.col(col).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]).limit(k)
