"""Writers for predictions and importance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_predictions(df: DataFrame, path: str, id_col: str = "reservation_id",
                      pred_col: str = "prediction", out_name: str | None = None,
                      fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write ``id, prediction`` (distributed write, one file per task)."""
    out = df.select(id_col, df[pred_col].alias(out_name or pred_col))
    _write(out, path, fmt, mode)


def write_importance(df: DataFrame, path: str, fmt: str = "csv",
                     mode: str = "overwrite") -> None:
    """Write a feature-importance report (small; files as its tasks make
    them, the stage before it keeps its parallelism)."""
    _write(df, path, fmt, mode)
