"""Group statistics fitted on some rows and given to others.

``group_back`` describes every group by all its rows.  Here a group's state
(count, mean, sum of squared deviations, smallest and largest value of each
measure) is fitted on a subset, written, and joined to any rows:

* ``fit_states`` fits on a frame (training rows, say), ``apply_states`` attaches
  the statistics to any frame with the keys, as often as wanted;
* ``merge_states`` adds states of further rows (a new month) without the old
  rows: states of one key are combined pairwise, which keeps the precision of
  the squared deviations;
* ``out_of_fold`` gives a row of fold f the statistics of its group's rows in
  all other folds, and rows without a fold those of all folds, so a statistic of
  the target never holds the row's own target.

Partial aggregation runs map-side, so a hot key costs one row a task; a key has
at most one state per fold or merged table.  The join back is ``group_back``'s:
broadcast behind measured sizes, narrow sort-merge joins beyond.

NULL keys form no group, and keys that the fitted rows lack get NULL for every
statistic, counts included; NaN measures are skipped; std of one row is NULL.
"""

from __future__ import annotations

import concurrent.futures as cf
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.operators.group_back import (
    KeySetPlan, MaterializedAgg, Spec, _measure, _size_columns, attach, output_names, plan_key_sets)
from grainline.session import materialize

ANY_FOLD = -1
_FOLD = "_state_fold"


@dataclass
class KeySetState:
    """States of one key set: ``table`` has the keys (and the fold) and a
    struct column per measure."""
    plan: KeySetPlan
    columns: dict[str, str]   # measure -> state column
    table: DataFrame


def _state(df: DataFrame, col: str, counted_only: bool) -> Column:
    m = _measure(df, col)
    n = F.count(m).alias("n")
    if counted_only:
        return F.struct(n)
    spread = (F.coalesce(F.var_pop(m), F.lit(0.0)) * F.count(m)).alias("m2")
    return F.struct(n, F.coalesce(F.avg(m), F.lit(0.0)).alias("mean"), spread, F.min(m).alias("low"), F.max(m).alias("high"))


def fit_states(df: DataFrame, specs: Sequence[Spec], by: str | None = None, parallelism: int = 8) -> list[KeySetState]:
    """The state of every group of every key set; with ``by`` one per group
    and value of that column."""
    def one(plan: KeySetPlan) -> KeySetState:
        measures: dict[str, bool] = {}
        for stat, col in plan.aggs:
            measures[col] = measures.get(col, True) and stat == "count"
        names = {col: f"_s{i}" for i, col in enumerate(measures)}
        known = F.lit(True)
        for k in plan.keys:
            known = known & F.col(k).isNotNull()
        keys = [*plan.keys, *([F.col(by).alias(_FOLD)] if by else [])]
        table = df.where(known).groupBy(*keys).agg(*[_state(df, col, only).alias(names[col]) for col, only in measures.items()])
        return KeySetState(plan, names, materialize(table, "state"))

    plans = plan_key_sets(specs)
    with cf.ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(one, plans))


def _merged(states: Column, fields: Sequence[str]) -> Column:
    """One state of an array of states (Chan's pairwise update)."""
    if list(fields) == ["n"]:
        return F.struct(F.aggregate(states, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))

    def add(a: Column, x: Column) -> Column:
        n = a["n"] + x["n"]
        gap, share = x["mean"] - a["mean"], F.try_divide(x["n"].cast("double"), n.cast("double"))
        moved = a["mean"] + F.coalesce(gap * share, F.lit(0.0))
        spread = a["m2"] + x["m2"] + F.coalesce(gap * gap * a["n"] * share, F.lit(0.0))
        return F.struct(n.alias("n"), moved.alias("mean"), spread.alias("m2"), F.least(a["low"], x["low"]).alias("low"), F.greatest(a["high"], x["high"]).alias("high"))

    first, rest = states[0], F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0)))
    return F.when(F.size(states) > 0, F.aggregate(rest, first, add))


def _fields(state: KeySetState, col: str) -> list[str]:
    return state.table.schema[col].dataType.names


def merge_states(*fits: list[KeySetState]) -> list[KeySetState]:
    """States of the rows of all fits together (same specs, same order)."""
    out = []
    for parts in zip(*fits, strict=True):
        base = parts[0]
        union = base.table
        for p in parts[1:]:
            union = union.unionByName(p.table)
        keys = [c for c in base.table.columns if c not in base.columns.values()]
        lists = union.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in base.columns.values()])
        table = lists.select(*keys, *[_merged(F.col(c), _fields(base, c)).alias(c) for c in base.columns.values()])
        out.append(KeySetState(base.plan, base.columns, materialize(table, "state")))
    return out


def _statistic(state: Column, stat: str) -> Column:
    n = state["n"]
    if stat == "count":
        return F.when(n > 0, n)
    if stat in ("min", "max"):
        return F.when(n > 0, state["low" if stat == "min" else "high"])
    if stat == "mean":
        return F.when(n > 0, state["mean"])
    return F.when(n > 1, F.sqrt(F.try_divide(state["m2"], (n - 1).cast("double"))))


def _attached(df: DataFrame, states: list[KeySetState], specs: Sequence[Spec], id_col: str, extra: tuple[str, ...], limits: dict) -> DataFrame:
    aggs = []
    for s in states:
        plan = KeySetPlan((*s.plan.keys, *extra), s.plan.aggs, s.plan.outputs)
        table = s.table.select(*plan.keys, *[_statistic(F.col(s.columns[col]), stat).alias(name) for (stat, col), name in s.plan.aggs.items()])
        size = table.agg(*_size_columns(table)).first()  # one row
        aggs.append(MaterializedAgg(plan, table, size["_rows"], size["_bytes"]))
    return attach(df, aggs, id_col, **limits).select(*[c for c in df.columns if c not in extra], *output_names(specs))


def apply_states(df: DataFrame, states: list[KeySetState], specs: Sequence[Spec], id_col: str = "reservation_id", **limits) -> DataFrame:
    """``df`` with the statistics of the fitted rows of each row's groups."""
    return _attached(df, states, specs, id_col, (), limits)


def group_back_fitted(df: DataFrame, specs: Sequence[Spec], fit_on: str | Column, id_col: str = "reservation_id", **limits) -> DataFrame:
    """``group_back`` whose statistics come from the rows where ``fit_on``
    holds, attached to all rows."""
    return apply_states(df, fit_states(df.where(fit_on), specs), specs, id_col, **limits)


def out_of_fold(df: DataFrame, specs: Sequence[Spec], fold_col: str = "fold", id_col: str = "reservation_id", **limits) -> DataFrame:
    """``df`` with each row's group statistics over the rows of other folds
    (over the rows of all folds where ``fold_col`` is NULL)."""
    states = fit_states(df.where(F.col(fold_col).isNotNull()), specs, by=fold_col)
    others = []
    for s in states:
        keys, cols = list(s.plan.keys), list(s.columns.values())
        parts = s.table.groupBy(*keys).agg(F.collect_list(F.struct(_FOLD, *cols)).alias("_parts"))
        each = parts.select(*keys, "_parts", F.explode(F.concat(F.col(f"_parts.{_FOLD}"), F.array(F.lit(ANY_FOLD)))).alias(_FOLD))
        left = F.filter("_parts", lambda p: p[_FOLD] != F.col(_FOLD))
        table = each.withColumn("_left", left).select(*keys, _FOLD, *[_merged(F.col(f"_left.{c}"), _fields(s, c)).alias(c) for c in cols])
        others.append(KeySetState(s.plan, s.columns, materialize(table, "state")))
    rows = df.withColumn(_FOLD, F.coalesce(F.col(fold_col), F.lit(ANY_FOLD)))
    return _attached(rows, others, specs, id_col, (_FOLD,), limits)
