"""Plan checks: pruned scans, one member shuffle for all sequence
orderings, no single-partition window on the detail, no Python UDF in the
feature plans, broadcast joins only for size-checked aggregates."""
import importlib

import pytest
from pyspark.sql import functions as F

from grainline.functions import parse_dates
from grainline.plans import bookings as B
from grainline.plans import manifest as M
from grainline.plans.queries import prepared, sequenced

SF = "/root/testdata/sf0.001"
G = importlib.import_module("grainline.operators.group_back")
E = importlib.import_module("grainline.operators.explore")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_one_shuffle_no_single_partition(spark):
    base = prepared(spark, SF)
    plan = _plan(B.sequences(base, write=False))
    assert plan.count("Exchange hashpartitioning(memberid") == 1
    assert "SinglePartition" not in plan
    assert plan.count("Window [") == 3
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_group_back_broadcasts_and_pruned_scans(spark):
    seq = sequenced(spark, SF)
    specs = M.count_specs_wide() + M.stats_specs_season()
    plans = G.plan_key_sets(specs)
    aggs = G.materialize_aggregates(seq, plans, 4)
    assert len(aggs) == len(plans)
    out = G.attach(seq.select("reservation_id", "ci_month", "ci_wday", "bk_month", "bk_wday",
                              *sorted({k for s in specs for k in s.keys} - {"ci_month", "ci_wday",
                                                                            "bk_month", "bk_wday"})),
                   aggs, "reservation_id")
    plan = _plan(out)
    assert plan.count("BroadcastHashJoin") == len(plans)
    assert "SortMergeJoin" not in plan
    # budget of zero: every aggregate goes through the shuffle path
    forced = _plan(G.attach(seq, aggs, "reservation_id", broadcast_total_bytes=0))
    assert forced.count("LeftOuter") >= len(plans)


def test_aggregate_scan_reads_only_needed_columns(spark):
    seq = sequenced(spark, SF)
    plan = G.plan_key_sets([G.StatsBy(("ci_month", "roomnights"), "total_pax")])[0]
    text = _plan(G.aggregate_key_set(seq, plan))
    schema = text[text.index("ReadSchema: "):].split("\n")[0]
    assert "roomnights" in schema and "total_pax" in schema and "reservation_id" not in schema
    assert "PartialAggregate" in text or "partial_" in text


def test_strict_date_parse_raises(spark):
    df = spark.createDataFrame([("3/10/2018",), ("junk",)], "t string")
    assert parse_dates(df, ["t"]).where(F.col("t").isNull()).count() == 1
    with pytest.raises(Exception):
        parse_dates(df, ["t"], strict=True).collect()


def test_hot_key_shuffle_path_matches_broadcast(spark):
    """A key holding a third of the rows: shuffle path (AQE skew join) and
    broadcast path give the same features; no row is dropped."""
    df = spark.range(0, 3000).select(
        F.col("id").alias("reservation_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") % 7).cast("double").alias("m"))
    specs = [G.CountBy(("k",)), G.StatsBy(("k",), "m")]
    a = G.group_back(df, specs, "reservation_id", broadcast_total_bytes=0).orderBy("reservation_id")
    b = G.group_back(df, specs, "reservation_id").orderBy("reservation_id")
    ra, rb = a.collect(), b.collect()
    assert len(ra) == 3000 and [tuple(r) for r in ra] == [tuple(r) for r in rb]
    hot = sum(1 for i in range(3000) if i % 3 == 0 or i % 97 == 0)
    assert ra[0]["cnt__by__k"] == hot


@pytest.mark.parametrize("name", ["frequency_compare", "key_overlap", "profile_nulls", "calendar_parts", "ratios"])
def test_reports_scan_each_table_once(spark, name):
    """The fixture's joins are built once (the report's own small written
    tables aside)."""
    from grainline.plans import queries as Q
    captured = []
    keep = E.materialize

    def spy(df, label="t"):
        captured.append(df)
        return keep(df, label)
    E.materialize = spy
    try:
        df = Q.QUERIES[name](spark, SF)
    finally:
        E.materialize = keep
    source = captured[0] if captured else df
    text = source._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("l_orderkey") and text.count("Relation [o_orderkey") == 1 and text.count("Relation [l_orderkey") == 1
