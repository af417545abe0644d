"""Label coding by first appearance (``pd.factorize`` semantics).

The code of a value is the rank of its first position in a given order;
missing values get ``-1`` (and so form one shared group afterwards), as do
values never seen in the rows the codes are fitted on.

Plan: one pass unpivots the coded columns to (column, value, position) and
``groupBy(column, value).agg(min(position))`` reduces it to one row per distinct
value (combined map-side, so hot values cost nothing).  These rows are
numbered by ``running_count`` (ranges plus offsets; no task sees all values)
in the order (column, first position); a column's first number is taken off.
The first position of a value is taken per all but the last part of the order
first: that aggregate hashes, while the smallest of a struct needs all rows
sorted in each task.  Code tables of up to ``BROADCAST_CODES`` rows are broadcast, larger
ones joined in partitions of a bounded size (``dealt_join``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.operators.dealing import dealt_join
from grainline.operators.ranking import global_rank
from grainline.operators.sequence import Order, as_orders
from grainline.session import materialize, partitions_for

# Rows of a code table that is broadcast.
BROADCAST_CODES = 200_000

def position_key(order_by: Sequence[str | Order]) -> Column:
    """A struct whose ascending order is the given order (numeric columns
    only for descending keys)."""
    parts = []
    for i, o in enumerate(as_orders(order_by)):
        c = F.col(o.col)
        parts.append((c if o.ascending else -c).alias(f"k{i}"))
    return F.struct(*parts)


def code_tables(src: DataFrame, cols: Sequence[str], order_by: Sequence[str | Order]) -> DataFrame:
    """(column number, value as text, code) of all columns, written."""
    items = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(cols)])
    long = src.select(position_key(order_by).alias("_p"), F.explode(items).alias("_e")).select("_p", "_e._c", "_e._v")
    known = long.where(F.col("_v").isNotNull())
    *lead, last = [f"k{i}" for i in range(len(as_orders(order_by)))]
    p = F.col(f"_p.{last}")
    # NULL comes first, as it does in a struct
    least = F.when(F.max(p.isNull()), F.lit(None)).otherwise(F.min(p))
    each = known.groupBy("_c", "_v", *[F.col(f"_p.{k}").alias(k) for k in lead]).agg(least.alias(last))
    firsts = each.groupBy("_c", "_v").agg(F.min(F.struct(*lead, last)).alias("_first"))
    ranked = materialize(global_rank(firsts, [F.col("_c").asc(), F.col("_first").asc()], "_r").drop("_first"), "codes")
    base = ranked.groupBy("_c").agg(F.min("_r").alias("_r0"))  # one row per column
    return ranked.join(F.broadcast(base), "_c").select("_c", "_v", (F.col("_r") - F.col("_r0")).cast("long").alias("_code"))


def first_seen_index(df: DataFrame, cols: Sequence[str], order_by: Sequence[str | Order],
                     fit_on: DataFrame | None = None, missing: int = -1,
                     suffix: str = "") -> DataFrame:
    """Replace each column in ``cols`` (or add ``col + suffix``) by its
    first-appearance code.  Codes are fitted on ``fit_on`` (default ``df``).
    Values are told apart by their text form."""
    tables = code_tables(fit_on if fit_on is not None else df, cols, order_by)
    sizes = {r["_c"]: r["count"] for r in tables.groupBy("_c").count().collect()}  # a row per column
    parts = partitions_for(df) if max(sizes.values(), default=0) > BROADCAST_CODES else 0
    out = df
    for i, col in enumerate(cols):
        mapping = tables.where(F.col("_c") == i).select("_v", "_code")
        rows = out.withColumn("_v", F.col(col).cast("string"))
        joined = (rows.join(F.broadcast(mapping), "_v", "left") if sizes.get(i, 0) <= BROADCAST_CODES
                  else dealt_join(rows, mapping, ["_v"], parts, df.select(F.col(col).cast("string").alias("_v"))))
        out = (joined
               .withColumn(col + suffix, F.coalesce(F.col("_code"), F.lit(missing).cast("long")))
               .drop("_v", "_code"))
    return out
