"""Per-entity sequence features: previous / next values in a fixed order.

``sequence_shift`` is ``lag``/``lead`` over ``partitionBy(by).orderBy(order)``;
all shifts of one ordering share one ``Window`` node and all orderings share
one shuffle on ``by``.

A window puts an entity into one task.  Entities with more than
``hot_group_rows`` rows (a pre-aggregated count finds them; at most
rows / hot_group_rows of them exist) are therefore cut into ranges first:

* their rows are range-partitioned on ``(by, order...)``, whose sampled bounds
  split a hot entity over many tasks, and written with the number of their
  range, by which they are placed: a task gets one range;
* ``lag``/``lead`` run per (entity, range), which is right for all rows but the
  first and last K of a range;
* these edge rows (2 * K per entity and range) hold, in order, all rows that
  they need, so ``lag``/``lead`` over the edge rows alone give their values.

Rows are dealt by entity (and ranges cut) into so many partitions that each holds
about ``PARTITION_ROWS`` rows, whatever the session's number of shuffle
partitions: the sorts of a task hold its partition, and its size must not grow
with the table.

Both ways are the same JVM window functions on the same columns, so values and
types are equal whatever the size.  Rows whose ``by`` key is NULL get NULL
shifts (pandas drops NaN groups).  The order must be total (end it with a
unique column) for results to be deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.session import materialize, partitions_for

DEFAULT_HOT_GROUP_ROWS = 5_000_000


@dataclass(frozen=True)
class Order:
    """One sort key; NULLs always sort last, as pandas sorts NaN last."""
    col: str
    ascending: bool = True

    def expr(self) -> Column:
        c = F.col(self.col)
        return c.asc_nulls_last() if self.ascending else c.desc_nulls_last()

    def reverse(self) -> Column:
        c = F.col(self.col)
        return c.desc_nulls_first() if self.ascending else c.asc_nulls_first()


def as_orders(order_by: Sequence[str | Order]) -> list[Order]:
    return [o if isinstance(o, Order) else Order(o) for o in order_by]


def shift_name(col: str, k: int) -> str:
    return f"{col}__lag{k}" if k > 0 else f"{col}__lead{-k}"


def _by_list(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _all_set(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in by])


def _shifted(w, shifts: list[tuple[str, int, str]]) -> dict[str, Column]:
    return {name: (F.lag(col, k) if k > 0 else F.lead(col, -k)).over(w) for col, k, name in shifts}


def hot_groups(df: DataFrame, by: str | Sequence[str], limit: int) -> DataFrame:
    """The key of every group of more than ``limit`` rows, NULL keys
    included, written (partial aggregation, at most rows / limit rows)."""
    by = _by_list(by)
    return materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*by), "hot")


def place_groups(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """``df`` dealt by ``by``, about ``PARTITION_ROWS`` rows a partition; windows
    over ``by`` need no other shuffle.  Counts ``df``."""
    return df.repartition(partitions_for(df), *_by_list(by))


def _window_shifts(df: DataFrame, by: list[str], orders: list[Order],
                   shifts: list[tuple[str, int, str]]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*[o.expr() for o in orders])
    return df.withColumns({name: F.when(_all_set(by), c) for name, c in _shifted(w, shifts).items()})


def _range_shifts(df: DataFrame, by: list[str], orders: list[Order],
                  shifts: list[tuple[str, int, str]]) -> DataFrame:
    """Shifts of entities that span several ranges (see module doc)."""
    exprs = [F.col(b).asc_nulls_last() for b in by] + [o.expr() for o in orders]
    depth = max(abs(k) for _, k, _ in shifts)
    n = partitions_for(df)
    ranged = materialize(df.repartitionByRange(n, *exprs).withColumn("_range", F.spark_partition_id()), "ranges").repartitionById(n, F.col("_range"))
    part = Window.partitionBy(*by, "_range")
    inner = part.orderBy(*[o.expr() for o in orders])
    rows = (ranged.withColumns({**_shifted(inner, shifts), "_head": F.row_number().over(inner),
                                "_tail": F.row_number().over(part.orderBy(*[o.reverse() for o in orders]))}))
    edge = (F.col("_head") <= depth) | (F.col("_tail") <= depth)
    whole = Window.partitionBy(*by).orderBy(*[o.expr() for o in orders])
    over = _shifted(whole, shifts)
    edges = materialize(rows.filter(edge), "edges").withColumns({f"_e{i}": over[name] for i, (_, _, name) in enumerate(shifts)})
    fixed = edges.withColumns({name: F.when(F.col("_head" if k > 0 else "_tail") <= depth, F.col(f"_e{i}")).otherwise(F.col(name))
                               for i, (_, k, name) in enumerate(shifts)})
    cols = [*df.columns, *[name for _, _, name in shifts]]
    return rows.filter(~edge).select(*cols).union(fixed.select(*cols))


def sequence_shift(df: DataFrame, by: str | Sequence[str], cols: Sequence[str],
                   offsets: Sequence[int], order_by: Sequence[str | Order],
                   names: dict[tuple[str, int], str] | None = None,
                   hot_group_rows: int = DEFAULT_HOT_GROUP_ROWS,
                   hot: DataFrame | None = None) -> DataFrame:
    """Add ``col`` shifted by each offset (``k > 0``: k-th previous row,
    ``k < 0``: k-th next row) within each ``by`` group in ``order_by``.

    ``hot``: the result of ``hot_groups`` if the caller has it already (it is
    the same for several orderings); without hot groups such a caller places the
    rows itself (``place_groups``), once for all orderings."""
    by = _by_list(by)
    orders = as_orders(order_by)
    names = names or {}
    shifts = [(c, k, names.get((c, k), shift_name(c, k))) for c in cols for k in offsets if k != 0]
    if not shifts:
        return df
    placed = hot is not None
    if not placed:
        hot = hot_groups(df, by, hot_group_rows)
    if not hot.head(1):
        return _window_shifts(df if placed else place_groups(df, by), by, orders, shifts)
    # at most rows / hot_group_rows keys: the larger the data, the larger
    # hot_group_rows may be set
    keys = F.broadcast(hot.select(*[F.col(b).alias(f"_h_{b}") for b in by]))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_h_{b}")) for b in by])
    busy = df.join(keys, same, "left_semi")
    out = _window_shifts(place_groups(df.join(keys, same, "left_anti"), by), by, orders, shifts)
    split = _range_shifts(busy.filter(_all_set(by)), by, orders, shifts)
    none = busy.filter(~_all_set(by)).withColumns({name: F.lit(None).cast(df.schema[c].dataType) for c, _, name in shifts})
    return out.unionByName(split).unionByName(none)


def gap_name(col: str, k: int) -> str:
    return f"{col}__gap_lag{k}" if k > 0 else f"{col}__gap_lead{-k}"


def visit_gaps(df: DataFrame, by: str | Sequence[str], col: str, n: int,
               order_by: Sequence[str | Order], **kw) -> DataFrame:
    """Values of the ``n`` previous and ``n`` next rows of ``col`` and the
    differences ``col - shifted`` (the reference's date lags and gaps)."""
    offsets = list(range(1, n + 1)) + [-k for k in range(1, n + 1)]
    out = sequence_shift(df, by, [col], offsets, order_by, **kw)
    return out.withColumns({gap_name(col, k): F.col(col) - F.col(shift_name(col, k))
                            for k in offsets})
