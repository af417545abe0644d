"""Group-back: aggregate by a key set and attach the result to every detail
row ("group, aggregate, left-join back"), for many key sets at once.

Plan, per call:

1. Specs are fused by key set (order of keys ignored) and identical
   aggregates are computed once and aliased (the reference groups 134 times
   over 87 distinct key sets and repeats three statistics verbatim).
2. One pass of per-column HyperLogLog sketches bounds the group count of
   every key set (product of its columns' distinct counts, at most the row
   count).  Key sets with a small bound that share an aggregate list are
   computed together with ``GROUPING SETS``, at most ``SHARED_SETS`` sets and
   ``broadcast_max_rows`` groups a scan, so ``Expand`` stays narrow and the
   map-side hash tables fit;
   large ones get their own ``groupBy(keys).agg(...)``.  Partial
   aggregation runs map-side, so a hot key costs one row per map task.
   Rows with a NULL key never match the join back (pandas drops NaN keys),
   so they get NULL features.  Aggregates are written as Parquet to the
   checkpoint folder; jobs run concurrently from a driver thread pool.
3. The row count and the bytes of each written aggregate (string columns
   measured, others of fixed width) decide the join: at most
   ``broadcast_max_rows`` rows and ``broadcast_max_bytes`` bytes, and all broadcast tables of the
   call together within ``broadcast_total_bytes`` -> broadcast hash join,
   map-side, no shuffle of the detail.  One stage probes at most
   ``broadcast_stage_bytes`` of them, which is what an executor holds at once;
   the detail is written between such stages.  Larger aggregates -> the narrow projection
   ``(id, keys)`` is joined to the aggregate (``dealt_join``: sort-merge in
   partitions of a bounded size, hot keys by broadcast), and the narrow
   ``(id, features)`` result is joined back on the unique id.  The wide detail row is shuffled at most once, into so many
   partitions that each holds about ``PARTITION_ROWS`` rows: the sorts of a task,
   one for the detail and one per such aggregate, do not grow with the table.
"""

from __future__ import annotations

import concurrent.futures as cf
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
)

from grainline.operators.dealing import dealt_join
from grainline.session import materialize, partitions_for, release

STATS = ("min", "max", "mean", "std")

DEFAULT_BROADCAST_MAX_ROWS = 2_000_000
DEFAULT_BROADCAST_MAX_BYTES = 128 * 1024 * 1024
# Key sets that one GROUPING SETS scan computes at most.
SHARED_SETS = 12
# All broadcast aggregates of one call, and those that one stage probes: every
# executor holds the latter at once.
DEFAULT_BROADCAST_TOTAL_BYTES = 1024 * 1024 * 1024
DEFAULT_BROADCAST_STAGE_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class CountBy:
    """Count of non-null ``of`` per key set (pandas ``groupby().count()``)."""
    keys: tuple[str, ...]
    of: str = "reservation_id"
    name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys))

    def outputs(self) -> list[tuple[str, tuple[str, str]]]:
        out = self.name or "cnt__by__" + "__".join(self.keys)
        return [(out, ("count", self.of))]


@dataclass(frozen=True)
class StatsBy:
    """min / max / mean / sample std of ``measure`` per key set."""
    keys: tuple[str, ...]
    measure: str
    stats: tuple[str, ...] = STATS
    prefix: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "stats", tuple(self.stats))
        bad = set(self.stats) - set(STATS)
        if bad:
            raise ValueError(f"unknown statistics {sorted(bad)}")

    def outputs(self) -> list[tuple[str, tuple[str, str]]]:
        base = self.prefix or f"{self.measure}__by__" + "__".join(self.keys)
        return [(f"{s}__{base}" if self.prefix is None else f"{base}_{s}", (s, self.measure))
                for s in self.stats]


Spec = CountBy | StatsBy


@dataclass
class KeySetPlan:
    """Everything computed for one key set."""
    keys: tuple[str, ...]
    aggs: dict[tuple[str, str], str] = field(default_factory=dict)   # (stat, col) -> internal
    outputs: dict[str, str] = field(default_factory=dict)            # output name -> internal

    def add(self, out_name: str, agg: tuple[str, str]) -> None:
        if out_name in self.outputs:
            raise ValueError(f"duplicate output column {out_name!r}")
        internal = self.aggs.get(agg)
        if internal is None:
            internal = f"_a{len(self.aggs)}"
            self.aggs[agg] = internal
        self.outputs[out_name] = internal


def plan_key_sets(specs: Iterable[Spec]) -> list[KeySetPlan]:
    """Fuse specs by (unordered) key set, dedupe equal aggregates."""
    plans: dict[frozenset, KeySetPlan] = {}
    seen: set[str] = set()
    for spec in specs:
        k = frozenset(spec.keys)
        if len(k) != len(spec.keys):
            raise ValueError(f"repeated key in {spec.keys}")
        plan = plans.get(k)
        if plan is None:
            plan = plans[k] = KeySetPlan(keys=tuple(sorted(k)))
        for name, agg in spec.outputs():
            if name in seen:
                raise ValueError(f"duplicate output column {name!r}")
            seen.add(name)
            plan.add(name, agg)
    return list(plans.values())


def output_names(specs: Iterable[Spec]) -> list[str]:
    return [name for s in specs for name, _ in s.outputs()]


def _measure(df: DataFrame, col: str) -> Column:
    """NaN -> NULL for floating measures, so aggregates skip it (pandas)."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (DoubleType, FloatType)):
        return F.nanvl(c, F.lit(None).cast(DoubleType()))
    return c


def _agg_expr(df: DataFrame, stat: str, col: str) -> Column:
    m = _measure(df, col)
    if stat == "count":
        return F.count(m)
    if stat == "min":
        return F.min(m)
    if stat == "max":
        return F.max(m)
    if stat == "mean":
        return F.avg(m)
    if stat == "std":
        return F.stddev_samp(m)
    raise ValueError(stat)


def aggregate_key_set(df: DataFrame, plan: KeySetPlan) -> DataFrame:
    """``groupBy(keys).agg(...)`` over rows whose keys are all non-null."""
    not_null = F.lit(True)
    for k in plan.keys:
        not_null = not_null & F.col(k).isNotNull()
    exprs = [_agg_expr(df, stat, col).alias(internal)
             for (stat, col), internal in plan.aggs.items()]
    return df.where(not_null).groupBy(*plan.keys).agg(*exprs)


_FIXED_WIDTH = {BooleanType: 1, ByteType: 1, ShortType: 2, IntegerType: 4, DateType: 4,
                LongType: 8, DoubleType: 8, FloatType: 4}


def _size_columns(df: DataFrame) -> list[Column]:
    """Aggregates that measure a table: its rows, and its bytes in memory
    (16 a row, 8 and the width a field; text as long as it is)."""
    fixed = 16 + sum(8 + _FIXED_WIDTH.get(type(f.dataType), 0) for f in df.schema.fields)
    text = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema.fields
            if type(f.dataType) not in _FIXED_WIDTH]
    width = F.lit(fixed).cast("long")
    for t in text:
        width = width + t
    return [F.count(F.lit(1)).alias("_rows"), F.coalesce(F.sum(width), F.lit(0)).alias("_bytes")]


@dataclass
class MaterializedAgg:
    plan: KeySetPlan
    table: DataFrame
    rows: int
    est_bytes: int

    def fits_broadcast(self, max_rows: int, max_bytes: int) -> bool:
        return self.rows <= max_rows and self.est_bytes <= max_bytes


def split_by_size(aggs: Sequence[MaterializedAgg], max_rows: int, max_bytes: int,
                  total_bytes: int) -> tuple[list[MaterializedAgg], list[MaterializedAgg]]:
    """(broadcast, shuffle): smallest aggregates first while each fits the
    per-table bound and their sum fits the budget of the call."""
    small, large, used = [], [], 0
    for a in sorted(aggs, key=lambda a: a.est_bytes):
        if a.fits_broadcast(max_rows, max_bytes) and used + a.est_bytes <= total_bytes:
            small.append(a)
            used += a.est_bytes
        else:
            large.append(a)
    return small, large


def group_count_bounds(df: DataFrame, plans: Sequence[KeySetPlan]) -> list[int]:
    """Upper bound of every key set's group count: the product of its
    columns' distinct counts (+1 for NULL), at most the rows.  One pass with one HyperLogLog
    sketch per key column (one result row); the sketch error is covered by
    a 15% margin (3 standard errors)."""
    cols = sorted({k for p in plans for k in p.keys})
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(c, 0.05).alias(f"_d{i}")
                   for i, c in enumerate(cols)]).first()
    card = {c: int(row[f"_d{i}"] * 1.15) + 2 for i, c in enumerate(cols)}
    bounds = []
    for p in plans:
        b = 1
        for k in p.keys:
            b *= card[k]
        bounds.append(min(b, row["_n"]))
    return bounds


def _grouping_id(cols: Sequence[str], keys: Sequence[str]) -> int:
    """Spark's grouping_id(): one bit per grouping column, most significant
    first, set when the column is not part of the grouping set."""
    n, ks = len(cols), set(keys)
    return sum(1 << (n - 1 - i) for i, c in enumerate(cols) if c not in ks)


def shared_scan_aggregates(df: DataFrame, family: Sequence[KeySetPlan]) -> list[MaterializedAgg]:
    """Key sets with the same aggregate list computed in ONE scan with
    ``GROUPING SETS``; partial aggregation keeps the shuffle to one row per
    (set, group) and map task.  NULL-key groups appear in the result but
    never match an equi-join, so they leave the features NULL as required."""
    aggs = list(family[0].aggs.keys())
    cols = sorted({k for p in family for k in p.keys})
    exprs = [_agg_expr(df, stat, col).alias(f"_f{j}") for j, (stat, col) in enumerate(aggs)]
    g = df.groupingSets([list(p.keys) for p in family], *cols).agg(
        F.grouping_id().alias("_gid"), *exprs)
    table = materialize(g, "aggsets")
    sizes = {r["_gid"]: r for r in table.groupBy("_gid").agg(*_size_columns(table)).collect()}  # a row per set
    out = []
    for p in family:
        gid = _grouping_id(cols, p.keys)
        sub = table.where(F.col("_gid") == gid).select(
            *p.keys, *[F.col(f"_f{j}").alias(p.aggs[a]) for j, a in enumerate(aggs)])
        r = sizes.get(gid)
        out.append(MaterializedAgg(p, sub, r["_rows"] if r else 0, r["_bytes"] if r else 0))
    return out


def _shared_scans(family: Sequence[tuple[KeySetPlan, int]], max_groups: int) -> list[list[KeySetPlan]]:
    """Cut a family into scans: neighbours in key order share columns."""
    scans: list[list[KeySetPlan]] = []
    held = 0
    for p, bound in sorted(family, key=lambda x: x[0].keys):
        if not scans or len(scans[-1]) == SHARED_SETS or held + bound > max_groups:
            scans.append([])
            held = 0
        scans[-1].append(p)
        held += bound
    return scans


def materialize_aggregates(df: DataFrame, plans: Sequence[KeySetPlan], parallelism: int = 8,
                           shared_max_groups: int | None = DEFAULT_BROADCAST_MAX_ROWS
                           ) -> list[MaterializedAgg]:
    """Compute and write the aggregate of every key set.

    Key sets whose group count is bounded by ``shared_max_groups`` (product
    of per-column distinct counts) and that share an aggregate list are
    computed together, some in each scan (grouping sets); the others get their own
    ``groupBy``, so their shuffle rows stay narrow.  Jobs run
    concurrently from a driver thread pool."""
    def single(plan: KeySetPlan) -> list[MaterializedAgg]:
        t = materialize(aggregate_key_set(df, plan), "agg")
        size = t.agg(*_size_columns(t)).first()
        return [MaterializedAgg(plan, t, size["_rows"], size["_bytes"])]

    tasks = []
    if shared_max_groups is None or len(plans) <= 1:
        tasks = [(single, p) for p in plans]
    else:
        bounds = group_count_bounds(df, plans)
        families: dict[tuple, list[tuple[KeySetPlan, int]]] = {}
        for p, e in zip(plans, bounds):
            if e <= shared_max_groups:
                families.setdefault(tuple(p.aggs.keys()), []).append((p, e))
            else:
                tasks.append((single, p))
        for family in families.values():
            for scan in _shared_scans(family, shared_max_groups):
                tasks.append((lambda f: shared_scan_aggregates(df, f), scan) if len(scan) > 1
                             else (single, scan[0]))

    if parallelism <= 1 or len(tasks) <= 1:
        results = [fn(arg) for fn, arg in tasks]
    else:
        with cf.ThreadPoolExecutor(max_workers=parallelism) as pool:
            results = list(pool.map(lambda t: t[0](t[1]), tasks))
    order = {id(p): i for i, p in enumerate(plans)}
    flat = [m for r in results for m in r]
    return sorted(flat, key=lambda m: order[id(m.plan)])


def stages_by_size(aggs: Sequence[MaterializedAgg], stage_bytes: int) -> list[list[MaterializedAgg]]:
    """Cut broadcast aggregates, in their order, into stages of at most
    ``stage_bytes`` (a single larger one has a stage of its own)."""
    stages, held = [], 0
    for a in aggs:
        if not stages or held + a.est_bytes > stage_bytes:
            stages.append([])
            held = 0
        stages[-1].append(a)
        held += a.est_bytes
    return stages


def attach(df: DataFrame, aggs: Sequence[MaterializedAgg], id_col: str,
           broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS,
           broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
           broadcast_total_bytes: int = DEFAULT_BROADCAST_TOTAL_BYTES,
           broadcast_stage_bytes: int = DEFAULT_BROADCAST_STAGE_BYTES) -> DataFrame:
    """Join materialised aggregates back onto the detail (see module doc)."""
    small, large = split_by_size(aggs, broadcast_max_rows, broadcast_max_bytes,
                                 broadcast_total_bytes)

    out = df
    if large:
        parts = partitions_for(df)
        out = out.repartition(parts, id_col)
    for a in large:
        keys = list(a.plan.keys)
        narrow = df.select(id_col, *keys)
        feats = a.table.select(*keys, F.lit(True).alias("_met"), *[F.col(i).alias(o) for o, i in a.plan.outputs.items()])
        # matches alone: missing ids come back NULL below
        part = dealt_join(narrow, feats, keys, parts).where("_met").drop(*keys, "_met").repartition(parts, id_col)
        out = out.join(part, id_col, "left")
    written = None
    for n, stage in enumerate(stages_by_size(small, broadcast_stage_bytes)):
        if n:
            done, written = written, materialize(out, "attached")
            out = written
            if done is not None:
                release(done)
        for a in stage:
            keys = list(a.plan.keys)
            feats = a.table.select(*keys, *[F.col(i).alias(o) for o, i in a.plan.outputs.items()])
            out = out.join(F.broadcast(feats), keys, "left")
    return out


def group_back(df: DataFrame, specs: Sequence[Spec], id_col: str = "reservation_id",
               broadcast_max_rows: int = DEFAULT_BROADCAST_MAX_ROWS,
               broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
               broadcast_total_bytes: int = DEFAULT_BROADCAST_TOTAL_BYTES,
               parallelism: int = 8,
               broadcast_stage_bytes: int = DEFAULT_BROADCAST_STAGE_BYTES) -> DataFrame:
    """Attach grouped counts / statistics to every row of ``df``.

    ``df`` should be materialised (a Parquet scan), since every key set
    scans it.  ``id_col`` must be unique.  Row count and row identity never
    change; the output holds the input columns plus one column per spec
    output, in the order of ``specs``.
    """
    plans = plan_key_sets(specs)
    aggs = materialize_aggregates(df, plans, parallelism)
    out = attach(df, aggs, id_col, broadcast_max_rows, broadcast_max_bytes,
                 broadcast_total_bytes, broadcast_stage_bytes)
    return out.select(*df.columns, *output_names(specs))


def group_back_plan_only(df: DataFrame, specs: Sequence[Spec],
                         id_col: str = "reservation_id") -> DataFrame:
    """Lazy variant without the size check: every aggregate is joined with
    a plain left join and AQE chooses the strategy at run time.  For small
    spec lists and for building oracle-comparable plans."""
    out = df
    for plan in plan_key_sets(specs):
        keys = list(plan.keys)
        agg = aggregate_key_set(df, plan)
        feats = agg.select(*keys, *[F.col(i).alias(o) for o, i in plan.outputs.items()])
        out = out.join(feats, keys, "left")
    return out.select(*df.columns, *output_names(specs))
