"""Row cleaning, source tagging and imputation (all narrow projections)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.functions.numeric import round_even, zero_of

SOURCE_COL = "train_set"


def reset_rows(df: DataFrame, pred: Column, mode: str = "zero_row",
               keep: Sequence[str] = ()) -> DataFrame:
    """Rows where ``pred`` holds: ``mode='zero_row'`` overwrites every column
    (except ``keep``) with the zero of its type, as a masked ``df[m] = 0``
    does (dates become 1970-01-01); ``mode='drop'`` removes the rows.
    A NULL predicate counts as false."""
    cond = F.coalesce(pred, F.lit(False))
    if mode == "drop":
        return df.where(~cond)
    if mode != "zero_row":
        raise ValueError(f"unknown mode {mode!r}")
    keep = set(keep)
    return df.select([
        F.col(f.name) if f.name in keep
        else F.when(cond, zero_of(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        for f in df.schema.fields])


def tag_source(train: DataFrame, test: DataFrame, flag: str = SOURCE_COL) -> DataFrame:
    """Union by name, flag = 1 for the first input and 0 for the second.
    Columns missing on one side (the target on test) come back NULL."""
    return (train.withColumn(flag, F.lit(1))
            .unionByName(test.withColumn(flag, F.lit(0)), allowMissingColumns=True))


def split_source(df: DataFrame, flag: str = SOURCE_COL) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(flag) == 1), df.where(F.col(flag) == 0)


def impute(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill NULL (and NaN) per column with a constant."""
    cols = {}
    types = dict(df.dtypes)
    for c, v in values.items():
        x = F.col(c)
        if types[c] in ("double", "float"):
            x = F.nanvl(x, F.lit(None).cast(types[c]))
        cols[c] = F.coalesce(x, F.lit(v).cast(types[c]))
    return df.withColumns(cols)


def round_columns(df: DataFrame, cols: Sequence[str], digits: int = 0) -> DataFrame:
    """Round half-even in place, keeping the column type."""
    types = dict(df.dtypes)
    return df.withColumns({c: round_even(c, digits).cast(types[c]) for c in cols})
