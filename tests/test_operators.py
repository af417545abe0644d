"""Operator goldens and properties (N1-N5, N11-N14, Q1-Q4)."""
import datetime as dt
import importlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainline.operators import (
    CountBy, StatsBy, exact_quantiles, first_seen_index, global_rank, group_back,
    group_back_plan_only, plan_key_sets, reset_rows, sequence_shift, tag_source, visit_gaps)
from grainline.operators.explore import describe_by, merge_sketches, quantile_sketch, sketch_error, sketch_quantiles
from grainline.operators.group_state import apply_states, fit_states, group_back_fitted, merge_states, out_of_fold
from grainline.operators.sequence import Order


@pytest.fixture
def detail(spark):
    rows = [
        (1, "a", 1, 2.0), (2, "a", 1, 4.0), (3, "a", 2, None), (4, "b", 1, 1.0),
        (5, None, 1, 7.0), (6, "b", None, float("nan")), (7, "c", 3, 5.0),
    ]
    return spark.createDataFrame(rows, "id long, k string, j int, m double")


def test_group_back_null_keys_and_nan(detail):
    out = group_back(detail, [CountBy(("k",), "id"), StatsBy(("k",), "m")], "id").orderBy("id")
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["cnt__by__k"] == 3 and got[4]["cnt__by__k"] == 2
    assert got[5]["cnt__by__k"] is None            # N1: NULL key -> NULL feature
    assert got[4]["max__m__by__k"] == 1.0           # N5: NaN skipped
    assert got[7]["std__m__by__k"] is None          # N4: one row -> NULL sample std
    assert got[1]["mean__m__by__k"] == 3.0 and got[1]["min__m__by__k"] == 2.0
    assert abs(got[1]["std__m__by__k"] - math.sqrt(2.0)) < 1e-12


def test_group_back_paths_agree(detail):
    specs = [CountBy(("k", "j"), "id"), StatsBy(("j",), "m"), CountBy(("j", "k"), "id", name="dup")]
    a = group_back(detail, specs, "id", broadcast_max_rows=10**9).orderBy("id").collect()
    b = group_back(detail, specs, "id", broadcast_max_rows=0).orderBy("id").collect()
    c = group_back_plan_only(detail, specs, "id").orderBy("id").collect()
    def norm(rows):
        return [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    assert norm(a) == norm(b) == norm(c)
    # broadcast tables probed in stages of their own, the detail written between
    specs3 = [*specs, CountBy(("k",), "id"), StatsBy(("k",), "m")]
    one = group_back(detail, specs3, "id").orderBy("id").collect()
    staged = group_back(detail, specs3, "id", broadcast_stage_bytes=1)
    assert norm(one) == norm(staged.orderBy("id").collect())
    assert staged._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
    # key order does not matter: same aggregate, two names (Q4)
    assert all(r["dup"] == r["cnt__by__k__j"] for r in a)


def test_fusion_by_key_set():
    specs = [CountBy(("a", "b")), StatsBy(("b", "a"), "m"), StatsBy(("b", "a"), "m", prefix="again")]
    plans = plan_key_sets(specs)
    assert len(plans) == 1
    assert len(plans[0].aggs) == 5          # count + 4 stats, repeats computed once
    assert len(plans[0].outputs) == 9


def test_reset_rows_zero_row(spark):
    df = spark.createDataFrame([(1, -1, "x", dt.date(2019, 1, 2), 3.5), (2, 2, "y", dt.date(2019, 1, 3), 1.0)],
                               "id long, n int, s string, d date, v double")
    got = reset_rows(df, F.col("n") < 0, keep=["id"]).orderBy("id").collect()
    assert tuple(got[0]) == (1, 0, "0", dt.date(1970, 1, 1), 0.0)     # Q1
    assert tuple(got[1]) == (2, 2, "y", dt.date(2019, 1, 3), 1.0)
    assert reset_rows(df, F.col("n") < 0, mode="drop").count() == 1


def test_tag_source_union(spark):
    tr = spark.createDataFrame([(1, 2.0)], "id long, y double")
    te = spark.createDataFrame([(2,)], "id long")
    got = tag_source(tr, te).orderBy("id").collect()
    assert [(r.id, r.y, r.train_set) for r in got] == [(1, 2.0, 1), (2, None, 0)]


def test_first_seen_index(spark):
    df = spark.createDataFrame([(1, 1, "b"), (2, 1, "a"), (3, 1, None), (4, 0, "c"), (5, 0, "a")],
                               "id long, train_set int, v string")
    order = [Order("train_set", ascending=False), Order("id")]
    got = first_seen_index(df.withColumn("w", F.col("train_set")), ["v", "w"], order).orderBy("id").collect()
    assert [r.v for r in got] == [0, 1, -1, 2, 1]          # N2, N14
    assert [r.w for r in got] == [0, 0, 0, 1, 1]


def _member_frame(spark, n_hot=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    i = 0
    for m, size in [(0, n_hot), (1, 5), (2, 1), (None, 3), (3, 7)]:
        for _ in range(size):
            day = int(rng.integers(0, 50))
            rows.append((i, m, day if rng.random() > 0.05 else None, int(rng.integers(0, 9)), f"r{rng.integers(0, 4)}"))
            i += 1
    return spark.createDataFrame(rows, "id long, m long, d int, v int, s string")


@pytest.fixture
def many_ranges(spark):
    """Small data in many ranges: AQE would merge them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, old)


BIG = 2 ** 53 + 1


def test_sequence_ranges_are_exact(many_ranges):
    """Hot groups by ranges give the window's values: long above 2^53, NaN,
    NULL and exact types, also in columns that only pass through."""
    spark = many_ranges
    nan = float("nan")
    rows = [(i, None if i % 11 == 0 else i % 3 if i % 2 else 0, i % 17 if i % 13 else None, BIG + i if i % 7 else None,
             nan if i % 5 == 0 else i / 3 if i % 4 else None, f"s{i}", BIG + 2 * i) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, m int, d int, v long, x double, s string, keep long")
    order = [Order("d"), Order("id")]
    kw = dict(by="m", cols=["v", "x", "s", "d"], offsets=[1, 2, 3, -1, -2, -3], order_by=order)
    whole = sequence_shift(df, **kw)
    split = sequence_shift(df, hot_group_rows=20, **kw)
    assert whole.schema.simpleString() == split.schema.simpleString()
    text = lambda f: sorted(repr(tuple(r)) for r in f.collect())
    a, b = text(whole), text(split)
    assert len(a) == 600 and a == b
    by_id = {r.id: r for r in split.collect()}
    assert all(r.keep == BIG + 2 * i and (r.m is not None or r.v__lag1 is None) for i, r in by_id.items())
    ranges = sequence_shift(df, hot_group_rows=20, **kw)._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in ranges


def test_sequence_short_ranges(many_ranges):
    """Ranges shorter than the deepest shift."""
    df = many_ranges.createDataFrame([(i, 0, i) for i in range(9)], "id long, m int, v long")
    got = sequence_shift(df, "m", ["v"], [4, -4], [Order("id")], hot_group_rows=1).orderBy("id").collect()
    assert [r.v__lag4 for r in got] == [None] * 4 + list(range(5))
    assert [r.v__lead4 for r in got] == list(range(4, 9)) + [None] * 4


def test_sequence_matches_pandas(spark):
    df = _member_frame(spark, n_hot=50, seed=3)
    pdf = df.toPandas().dropna(subset=["m"])
    order = [Order("d"), Order("id")]
    got = sequence_shift(df, "m", ["v"], [1, -2], order).toPandas().dropna(subset=["m"])
    pdf = pdf.sort_values(["d", "id"], na_position="last", kind="stable")
    exp1 = pdf.groupby("m")["v"].shift(1)
    exp2 = pdf.groupby("m")["v"].shift(-2)
    g = got.set_index("id")
    for idx, e1, e2 in zip(pdf["id"], exp1, exp2):
        a, b = g.loc[idx, "v__lag1"], g.loc[idx, "v__lead2"]
        assert (pd.isna(a) and pd.isna(e1)) or a == e1
        assert (pd.isna(b) and pd.isna(e2)) or b == e2


def test_visit_gaps_lag_then_lead_returns_row(spark):
    df = _member_frame(spark, n_hot=30)
    out = visit_gaps(df, "m", "d", 2, [Order("d"), Order("id")]).toPandas()
    assert "d__gap_lag1" in out and "d__gap_lead2" in out
    ok = out.dropna(subset=["d__lag1", "d"])
    assert (ok["d"] - ok["d__lag1"] == ok["d__gap_lag1"]).all()


def test_global_rank_and_quantiles(many_ranges):
    spark = many_ranges
    vals = [float(x) for x in np.random.default_rng(0).normal(size=301)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "x double, g int")
    ranks = global_rank(df, [F.col("x").asc()], "r").orderBy("r").toPandas()
    assert list(ranks["r"]) == list(range(301))
    assert list(ranks["x"]) == sorted(vals)
    q = exact_quantiles(df, "x", [0.25, 0.5, 0.9]).collect()[0]
    exp = np.quantile(vals, [0.25, 0.5, 0.9])
    assert np.allclose([q.q0, q.q1, q.q2], exp)
    qg = {r.g: r for r in exact_quantiles(df, "x", [0.5], ["g"]).collect()}
    for g in range(3):
        assert np.isclose(qg[g].q0, np.median([v for i, v in enumerate(vals) if i % 3 == g]))


def test_quantiles_of_ties(many_ranges, monkeypatch):
    """70 % equal values: what is dealt out by ranges has one row per value,
    so no task gets the ties."""
    from grainline.operators import ranking
    spark = many_ranges
    df = spark.range(0, 20000).select(F.when(F.col("id") % 10 < 7, 5.0).otherwise(F.col("id") * 1.0).alias("x"),
                                      F.when(F.col("id") % 2 == 0, 1).alias("g"))
    seen = []
    keep = ranking.materialize

    def spy(f, label="t"):
        out = keep(f, label)
        if label == "ranges":
            seen.append([r["count"] for r in out.groupBy("_range").count().collect()])
        return out
    monkeypatch.setattr(ranking, "materialize", spy)
    got = {r.g: (r.q0, r.q1) for r in exact_quantiles(df, "x", [0.5, 0.9], ["g"]).collect()}
    x = np.array([5.0 if i % 10 < 7 else float(i) for i in range(20000)])
    for g, part in ((1, x[::2]), (None, x[1::2])):
        assert np.allclose(got[g], np.quantile(part, [0.5, 0.9]))
    sizes = seen[0]
    assert sum(sizes) == len(np.unique(x[::2])) + len(np.unique(x[1::2]))
    assert max(sizes) <= 3 * sum(sizes) / len(sizes)
    assert exact_quantiles(df.where("id < 0") if "id" in df.columns else df.where("x < 0"), "x", [0.5]).collect()[0].q0 is None


def test_bookings_sequences_hot_member_path(spark):
    """The preset's sequences are the same when members go by ranges."""
    from grainline.plans import bookings as B
    from grainline.plans.queries import prepared
    base = prepared(spark, "/root/testdata/sf0.001")
    a = B.sequences(base, B.BookingsConfig(), write=False)
    b = B.sequences(base, B.BookingsConfig(hot_group_rows=20), write=False)
    assert a.schema.simpleString() == b.schema.simpleString()
    assert sorted(repr(tuple(r)) for r in a.collect()) == sorted(repr(tuple(r)) for r in b.collect())


def test_group_back_shared_scan_matches_separate(detail):
    """Grouping-sets scan (several key sets, one aggregate list) equals one
    groupBy per key set, NULL keys included."""
    specs = [CountBy(("k",), "id"), CountBy(("j",), "id"), CountBy(("k", "j"), "id"),
             StatsBy(("k",), "m", prefix="sk"), StatsBy(("j",), "m", prefix="sj")]
    shared = group_back(detail, specs, "id").orderBy("id").collect()
    import importlib
    G = importlib.import_module("grainline.operators.group_back")
    plans = G.plan_key_sets(specs)
    aggs = G.materialize_aggregates(detail, plans, shared_max_groups=None)
    sep = G.attach(detail, aggs, "id").select(*detail.columns, *G.output_names(specs)) \
        .orderBy("id").collect()
    norm = lambda rows: [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
                         for r in rows]
    assert norm(shared) == norm(sep)
    got = {r["id"]: r for r in shared}
    assert got[5]["cnt__by__k"] is None and got[5]["cnt__by__j"] == 4
    assert got[6]["cnt__by__j"] is None and got[6]["cnt__by__k__j"] is None


# ---- fitted group states -------------------------------------------------------

def _state_rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        key = rng.choice(["a", "b", "c", None]) if i % 3 else "hot"
        x = None if rng.random() < 0.1 else rng.choice([float("nan"), 1e9 + rng.random(), rng.gauss(0, 5)])
        rows.append((i, key, rng.randrange(3), x, rng.randrange(5) if i % 11 else None, i % 4 > 0))
    return rows, spark.createDataFrame(rows, "id long, k string, j int, x double, fold int, train boolean")


def _stats(values):
    v = [x for x in values if x is not None and x == x]
    if not v:
        return None, None, None, None, None
    mean = math.fsum(v) / len(v)
    std = (math.fsum((x - mean) ** 2 for x in v) / (len(v) - 1)) ** 0.5 if len(v) > 1 else None
    return len(v), min(v), max(v), mean, std


STATE_SPECS = [CountBy(("k",), of="x", name="n"), StatsBy(("k",), "x", prefix="x"), StatsBy(("j", "k"), "x", prefix="jk"), CountBy(("k",), of="id", name="ids")]


def _check(got, rows, use):
    close = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(b)))
    for r in got:
        i, k, j, _, fold, _ = rows[r.id]
        mine = [o for o in rows if k is not None and o[1] == k and use(rows[r.id], o)]
        exp = _stats([o[3] for o in mine])
        assert r.n == exp[0] and r.ids == (len(mine) or None)
        for a, b in zip((r.x_min, r.x_max, r.x_mean, r.x_std), exp[1:]):
            assert close(a, b), (r, exp)
        exp = _stats([o[3] for o in mine if o[2] == j])
        assert all(close(a, b) for a, b in zip((r.jk_min, r.jk_max, r.jk_mean, r.jk_std), exp[1:]))


@pytest.mark.parametrize("rows_limit", [2_000_000, 0])
def test_statistics_fitted_on_some_rows(spark, rows_limit):
    """Broadcast and shuffled join back; large values keep their spread."""
    rows, df = _state_rows(spark)
    got = group_back_fitted(df, STATE_SPECS, "train", "id", broadcast_max_rows=rows_limit).collect()
    assert len(got) == len(rows)
    _check(got, rows, lambda me, o: o[5])


def test_merged_states_are_states_of_all_rows(spark):
    rows, df = _state_rows(spark)
    parts = [fit_states(df.where(c), STATE_SPECS) for c in ("id % 3 = 0", "id % 3 = 1 and k <> 'a'", "id % 3 = 2", "false")]
    used = lambda me, o: o[0] % 3 != 1 or o[1] != "a"
    _check(apply_states(df, merge_states(*parts), STATE_SPECS, "id").collect(), rows, used)


def test_out_of_fold_statistics(spark):
    rows, df = _state_rows(spark)
    got = out_of_fold(df, STATE_SPECS, "fold", "id").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {*df.columns, "n", "ids", "x_min", "x_max", "x_mean", "x_std", "jk_min", "jk_max", "jk_mean", "jk_std"}
    _check(got, rows, lambda me, o: o[4] is not None and o[4] != me[4])
    alone = spark.createDataFrame([(1, "z", 1, 2.0, 0, True)], df.schema)
    assert out_of_fold(alone, STATE_SPECS, "fold", "id").first().n is None
    assert out_of_fold(df.limit(0), STATE_SPECS, "fold", "id").count() == 0


def test_quantile_sketches(spark):
    """Rank error with 70% ties, NaN, NULL, merged in any grouping."""
    rng = random.Random(4)
    values = [5.0 if rng.random() < 0.7 else rng.gauss(0, 100) for _ in range(40_000)]
    rows = [(x, i % 7) for i, x in enumerate(values)] + [(None, 1), (float("nan"), 2)]
    df = spark.createDataFrame(rows, "x double, part int").repartition(16)
    probs = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    for sketch in (quantile_sketch(df, "x"), merge_sketches(quantile_sketch(df, "x", ["part"]))):
        got = sketch_quantiles(sketch, probs, (), names).first()
        for p, q in zip(probs, got):
            below, upto = sum(x < q for x in values) / len(values), sum(x <= q for x in values) / len(values)
            assert below - sketch_error() <= p <= upto + sketch_error() and q in set(values)
    d = describe_by(df.where("x is not null and not isnan(x)"), "x", exact=False).first()
    assert d.n == len(values) and d.p50 == 5.0
    assert sketch_quantiles(quantile_sketch(df.limit(0), "x", ["part"]), [0.5], ["part"]).count() == 0


def test_stages_hold_their_bytes():
    from grainline.operators.group_back import MaterializedAgg, stages_by_size
    aggs = [MaterializedAgg(None, None, 1, b) for b in (1, 2, 3, 4, 20, 5)]
    assert [[a.est_bytes for a in st] for st in stages_by_size(aggs, 6)] == [[1, 2, 3], [4], [20], [5]]
    assert stages_by_size([], 6) == []


def test_partitions_follow_the_rows(spark, monkeypatch):
    """What a task sorts is bounded by rows, not by the session's shuffle partitions."""
    from grainline import session as S
    monkeypatch.setattr(S, "PARTITION_ROWS", 10)
    rows = S.materialize(spark.range(1000).selectExpr("id as reservation_id", "id % 90 as k", "id % 7 as v"), "rows")
    shifted = sequence_shift(rows, "k", ["v"], [1], ["reservation_id"])
    assert shifted.rdd.getNumPartitions() >= 100
    hot = sequence_shift(rows.withColumn("k", F.lit(1)), "k", ["v"], [1], ["reservation_id"], hot_group_rows=50)
    assert hot.rdd.getNumPartitions() >= 100
    assert {r.reservation_id: r["v__lag1"] for r in hot.collect()} == {i: (i - 1) % 7 if i else None for i in range(1000)}
    joined = group_back(rows, [CountBy(("k",), name="n")], broadcast_max_rows=0)
    assert joined.rdd.getNumPartitions() >= 100
    assert {r.k: r.n for r in joined.collect()} == {k: len(range(k, 1000, 90)) for k in range(90)}


def _exchanges(df):
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in x]


def test_dealt_join_equals_a_left_join(spark, monkeypatch):
    """Hot, missing, repeated, NaN and signed zero keys; no task gets a hot key's rows."""
    from grainline import session as S
    from grainline.operators.dealing import dealt_join
    monkeypatch.setattr(S, "PARTITION_ROWS", 20)
    rows = S.materialize(spark.range(1000).selectExpr(
        "id", "case when id < 500 then 7 when id < 600 then null else id % 90 end as k",
        "case id % 4 when 0 then -0.0D when 1 then double('nan') when 2 then 0.0D else 1.5D end as x"), "rows")
    table = spark.createDataFrame([(k, x, f"{k}:{x}" if k % 5 else None) for k in range(60) for x in (0.0, float("nan"), 1.5)] +
                                  [(7, 1.5, "again"), (61, 1.5, "twice"), (61, 1.5, "twice"), (None, 1.5, "none")], "k bigint, x double, v string")
    for keys in (["k"], ["k", "x"]):
        other = table.select(*keys, "v")
        got = dealt_join(rows.select("id", *keys), other, keys, 50)
        assert not [x for x in _exchanges(got) if "ENSURE_REQUIREMENTS" in x]
        want = rows.select("id", *keys).join(other, keys, "left").select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    alone = dealt_join(rows.select("id", "k"), spark.range(90).selectExpr("id as k", "id * 2 as w"), ["k"], 50)
    assert max(map(len, alone.rdd.glom().collect())) <= 60


def test_group_back_shuffle_joins_follow_the_rows(spark, monkeypatch):
    from grainline import session as S
    G = importlib.import_module("grainline.operators.group_back")
    monkeypatch.setattr(S, "PARTITION_ROWS", 10)
    rows = S.materialize(spark.range(1000).selectExpr("id as reservation_id", "if(id < 400, 3, id % 90) as k", "if(id % 3 = 0, null, id % 7 * 0.5D) as z"), "rows")
    specs = [CountBy(("k",), name="n"), CountBy(("k", "z"), name="m")]
    monkeypatch.setattr(G, "materialize", lambda df, label="table": S.materialize(df, label))
    aggs = G.materialize_aggregates(rows, plan_key_sets(specs), 1)
    out = G.attach(rows, aggs, "reservation_id", broadcast_max_rows=0)
    assert not [x for x in _exchanges(out) if "ENSURE_REQUIREMENTS" in x]
    got = {r.reservation_id: (r.n, r.m) for r in out.collect()}
    key = lambda i: 3 if i < 400 else i % 90
    both = lambda i: (key(i), i % 7) if i % 3 else None
    n, m = (pd.Series([f(i) for i in range(1000)]).value_counts() for f in (key, both))
    assert got == {i: (n[key(i)], m[both(i)] if i % 3 else None) for i in range(1000)}


def test_hot_ranges_are_placed_one_by_one(many_ranges, monkeypatch):
    """Ranges of a hot entity do not meet in a task."""
    from grainline import session as S
    monkeypatch.setattr(S, "PARTITION_ROWS", 10)
    rows = S.materialize(many_ranges.range(1000).selectExpr("id", "1 as k", "id % 7 as v"), "rows")
    out = sequence_shift(rows, "k", ["v"], [1], ["id"], hot_group_rows=50)
    assert [x for x in _exchanges(out) if "shufflepartitionidpassthrough" in x]
    assert {r.id: r["v__lag1"] for r in out.collect()} == {i: (i - 1) % 7 if i else None for i in range(1000)}


def test_first_seen_codes_of_a_large_column(spark, monkeypatch):
    """Codes joined by a shuffle equal broadcast ones; a NULL position comes first."""
    from grainline import session as S
    C = importlib.import_module("grainline.operators.coding")
    rows = S.materialize(spark.range(400).selectExpr("if(id % 37 = 5, null, id) as id", "id as row", "int(id % 2) as train_set",
                                                     "if(id < 150, 'hot', if(id % 11 = 0, null, concat('v', id % 100))) as v"), "rows")
    order = [Order("train_set", ascending=False), Order("id")]
    firsts = rows.where("v is not null").groupBy("v").agg(F.min(C.position_key(order)).alias("p")).collect()
    place = sorted(firsts, key=lambda r: (r.p.k0, r.p.k1 is not None, r.p.k1 or 0))
    # values whose first position is equal may be numbered either way
    rank = {r.v: (r.p.k0, r.p.k1) for r in place}
    small = {r.row: r.v_code for r in first_seen_index(rows, ["v"], order, suffix="_code").collect()}
    for r in rows.collect():
        assert small[r.row] == -1 if r.v is None else rank[place[small[r.row]].v] == rank[r.v]
    monkeypatch.setattr(C, "BROADCAST_CODES", 0)
    monkeypatch.setattr(S, "PARTITION_ROWS", 10)
    by_id = rows.withColumn("id", F.col("row"))
    large = first_seen_index(by_id, ["v"], order, suffix="_code")
    assert max(map(len, large.rdd.glom().collect())) <= 40
    monkeypatch.setattr(C, "BROADCAST_CODES", 10**6)
    assert sorted(large.collect()) == sorted(first_seen_index(by_id, ["v"], order, suffix="_code").collect())
