"""Sources, sinks, folds and the boosting loop."""
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainline.operators import (
    average_predictions, cv_report, fold_split, group_kfold, mean_of_columns, percent_of_total, rmse, top_k)
from grainline.operators.folds import even_folds
from grainline.operators.boosting import (
    BoostParams, assemble, cross_validate, fit_boosted, fit_missing, fit_selected, predict_rounds, truncated)
from grainline.sources import (
    BOOKING_SCHEMA, RAW_COLUMNS, bookings_pair, read_bookings, write_importance, write_predictions)

SF = "/root/testdata/sf0.001"


def test_read_csv_with_schema(spark):
    d = tempfile.mkdtemp(prefix="gl-csv-")
    path = os.path.join(d, "train.csv")
    header = ",".join(RAW_COLUMNS)
    row = ["r1", "3/10/2018", "5/10/2018", "7/10/2018", "3", "1", "2", "1", "45", "1", "2", "3",
           "2", "", "7", "5", "3", "30-40", "1", "m1", "F", "A", "res1", "1.5"]
    with open(path, "w") as f:
        f.write(header + "\n" + ",".join(row) + "\n")
    df = read_bookings(spark, path)
    r = df.collect()[0]
    assert df.schema["checkin_date"].dataType.simpleString() == "date"
    assert r.checkin_date.isoformat() == "2018-10-05" and r.season_holidayed_code is None
    assert r.amount_spent_per_room_night_scaled == 1.5 and r.numberofadults == 2


def test_read_csv_by_header_name(spark, tmp_path):
    """Columns in any order, a missing target, text that is no number."""
    cols = ["numberofchildren", "numberofadults", "reservation_id", "booking_date", "roomnights"]
    (tmp_path / "t.csv").write_text(",".join(cols) + "\n1,2,r1,3/10/2018,abc\n,4,r2,,5\n")
    path = str(tmp_path / "t.csv")
    a, b = read_bookings(spark, path, bad_col="bad").orderBy("reservation_id").collect()
    assert (a.numberofadults, a.numberofchildren, a.roomnights, a.bad) == (2, 1, None, 1)
    assert (b.numberofadults, b.numberofchildren, b.roomnights, b.bad) == (4, None, 5, 0)
    assert a.booking_date.isoformat() == "2018-10-03" and a.amount_spent_per_room_night_scaled is None
    with pytest.raises(Exception):
        read_bookings(spark, path, strict=True).collect()
    (tmp_path / "u.csv").write_text("reservation_id,other\nr1,2\n")
    with pytest.raises(ValueError):
        read_bookings(spark, str(tmp_path / "u.csv"))


def test_stage_folder(spark):
    """No shared folder on a cluster is an error; stages can be deleted."""
    from types import SimpleNamespace

    from grainline.session import ensure_checkpoint_dir, materialize, release
    conf = SimpleNamespace(get=lambda *a: None)
    for master, ok in (("yarn", False), ("local-cluster[2,1,1024]", False)):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf)
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
    df = materialize(spark.range(5), "gone")
    folder = df._stage_path.removeprefix("file:")
    assert os.path.isdir(folder) and df.count() == 5
    release(df, spark.range(1))
    assert not os.path.exists(folder)


def test_writers(spark):
    d = tempfile.mkdtemp(prefix="gl-out-")
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "reservation_id long, prediction double")
    write_predictions(df, os.path.join(d, "pred"), fmt="csv", out_name="amount")
    back = spark.read.option("header", True).csv(os.path.join(d, "pred"))
    assert sorted(back.columns) == ["amount", "reservation_id"] and back.count() == 2
    write_importance(df, os.path.join(d, "imp"))
    assert spark.read.option("header", True).csv(os.path.join(d, "imp")).count() == 2


def test_fixture_members_disjoint(spark):
    tr, te = bookings_pair(spark, SF)
    both = tr.select("memberid").distinct().join(te.select("memberid").distinct(), "memberid")
    assert both.count() == 0
    assert tr.count() + te.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_folds_disjoint_and_complete(spark):
    df = spark.range(0, 2000).select(F.col("id"), (F.col("id") % 137).alias("m"))
    f = group_kfold(df, "m", 10, 7)
    per_member = f.groupBy("m").agg(F.countDistinct("fold").alias("k")).where("k > 1").count()
    assert per_member == 0
    dev, val = fold_split(f, 3)
    assert dev.count() + val.count() == 2000
    assert f.select("fold").distinct().count() == 10


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0), (2, 3.0, 3.0, 0), (3, 0.0, 2.0, 1)],
                               "id long, y double, p double, fold int")
    r = {x.fold: x.rmse for x in rmse(df, "y", "p", ["fold"]).collect()}
    assert abs(r[0] - (0.5 ** 0.5)) < 1e-12 and r[1] == 2.0
    avg = {x.id: x.prediction for x in average_predictions(df.unionByName(df), "id", "p").collect()}
    assert avg[3] == 2.0
    pct = percent_of_total(df, "p", "share").agg(F.sum("share")).first()[0]
    assert abs(pct - 100.0) < 1e-9
    assert [x.id for x in top_k(df, "p", 3, tie=["id"]).collect()] == [2, 1, 3]
    wide = spark.createDataFrame([(1.0, 3.0, None), (None, None, None)], "a double, b double, c double")
    assert [tuple(r)[3:] for r in mean_of_columns(wide, ["a", "b", "c"]).collect()] == [(2, 2.0), (0, None)]
    rep = {x.fold: x for x in cv_report(df, "y", "p").collect()}
    assert (rep[0].n_rows, rep[1].n_rows) == (2, 1) and abs(rep[0].overall_rmse - (5 / 3) ** 0.5) < 1e-12


@pytest.fixture(scope="module")
def model_data(spark):
    rows = []
    for i in range(600):
        x1, x2 = (i * 7) % 13, (i * 3) % 5
        rows.append((i, i % 40, float(x1), float(x2) if i % 9 else None, 2.0 * x1 + x2 + (i % 3) * 0.1))
    df = spark.createDataFrame(rows, "id long, m long, x1 double, x2 double, y double")
    df = group_kfold(df, "m", 3, 1)
    return assemble(df, ["x1", "x2"], keep=["id", "fold", "y"])


def test_rounds_are_chosen_on_the_whole_curve(spark, model_data):
    params = BoostParams(max_rounds=24, first_rounds=6, patience=2, min_rows_per_leaf=5, learning_rate=0.3, subsample=1.0, feature_fraction="all")
    dev, val = fold_split(model_data, 0)
    chosen = fit_selected(dev, val, "y", params)
    m, curve = chosen.model, chosen.curve
    assert m.getNumTrees == chosen.rounds == curve.index(min(curve)) + 1 and len(curve) == chosen.fitted in (6, 12, 24)
    # the budget grew until the best round was old enough, or to its end
    assert chosen.fitted == 24 or chosen.rounds + 2 <= chosen.fitted
    whole = fit_boosted(dev, "y", params)
    for n in {1, chosen.rounds, chosen.fitted}:
        assert abs(rmse(predict_rounds(whole, val, n), "y", "prediction").first()["rmse"] - curve[n - 1]) < 1e-9
    pred = predict_rounds(m, val)
    err = rmse(pred, "y", "prediction").first()["rmse"]
    assert abs(err - min(curve)) < 1e-9
    mean = dev.agg(F.avg("y")).first()[0]
    base = rmse(val.withColumn("prediction", F.lit(mean)), "y", "prediction").first()["rmse"]
    assert err < 0.5 * base
    again = fit_selected(dev, val, "y", params)
    assert np.allclose(again.curve, curve, rtol=1e-12) and again.rounds == chosen.rounds  # sums over rows, in any order
    assert predict_rounds(again.model, val).select("prediction").collect() == pred.select("prediction").collect()
    # a patience that the first budget satisfies keeps it; no validation rows: the first budget
    assert fit_selected(dev, val, "y", BoostParams(**{**params.__dict__, "patience": 0})).fitted == 6
    none = fit_selected(dev, val.limit(0), "y", params)
    assert (none.rounds, none.fitted) == (6, 6)
    # fewer rounds: the weighted sum of the first trees
    part = truncated(m, 2)
    assert part.getNumTrees == 2
    for row in predict_rounds(m, val, 2).limit(20).collect():
        by_hand = sum(w * t.predict(row.features) for w, t in zip(m.treeWeights[:2], m.trees[:2]))
        assert abs(row.prediction - by_hand) < 1e-12


def test_cross_validate_covers_train_once(spark, model_data):
    params = BoostParams(max_rounds=5, first_rounds=5, min_rows_per_leaf=5, learning_rate=0.3)
    test = model_data.where("fold = 0").select("id", "features")
    res = cross_validate(model_data, test, "id", "y", params, k=3, parallelism=2,
                         feature_names=["x1", "x2"])
    oof = res.oof
    assert oof.count() == model_data.count()
    assert oof.select("id").distinct().count() == model_data.count()
    assert res.test.where("n_models = 3").count() == test.count()
    assert sorted(f["fold"] for f in res.folds) == [0, 1, 2] and all(f["fitted_rounds"] == 5 and abs(min(f["curve"]) - f["rmse"]) < 1e-9 for f in res.folds)
    imp = res.importance.collect()
    assert {(r.fold, r.stage, r.feature) for r in imp} == {(f, s, c) for f in range(3) for s in ("dev", "refit") for c in ("x1", "x2")}
    for f in range(3):
        assert abs(sum(r.gain for r in imp if (r.fold, r.stage) == (f, "refit") and r.gain is not None) - 100.0) < 1e-6
    assert res.test.where("prediction is null").count() == 0


def test_shorter_fit_is_prefix_of_longer(spark, model_data):
    params = BoostParams(max_rounds=8, min_rows_per_leaf=5, learning_rate=0.3)
    short = fit_boosted(model_data, "y", params, rounds=3, seed=2018)
    long = fit_boosted(model_data, "y", params, rounds=8, seed=2018)
    a = predict_rounds(short, model_data).orderBy("id").select("prediction").collect()
    b = predict_rounds(long, model_data, 3).orderBy("id").select("prediction").collect()
    assert a == b


def test_missing_values_lie_below_each_column(spark):
    nan = float("nan")
    rows = [(1, -5000.0, None, 1, None), (2, None, 3.0, 2, None), (3, nan, 1e12, 3, None), (4, 7.0, -2.0, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c int, d double")
    cols = ["a", "b", "c", "d"]
    plan = fit_missing(df, cols)
    assert plan.fills == {"a": -5001.0, "b": -3.0, "c": 0.0, "d": 0.0} and plan.flagged == ("a", "b", "c", "d")
    out = {r.id: r.features.toArray().tolist() for r in assemble(df, cols, ["id"], plan).collect()}
    assert out[1] == [-5000.0, -3.0, 1.0, 0.0, 0, 1, 0, 1] and out[3] == [-5001.0, 1e12, 3.0, 0.0, 1, 0, 0, 1]
    # later rows are filled by the fitted plan; columns without missing values have no indicator
    some = fit_missing(df.where("id < 3"), ["c"])
    assert some.flagged == () and some.names(["c"]) == ["c"]
    assert [r.features.toArray().tolist() for r in assemble(df.where("id = 4"), ["c"], ["id"], some).collect()] == [[0.0]]
    assert fit_missing(df.limit(0), cols).fills == dict.fromkeys(cols, 0.0)
    big = spark.createDataFrame([(-1e15,), (None,)], "x double")
    assert fit_missing(big, ["x"]).fills["x"] < -1e15


def test_files_with_different_headers(spark):
    d = tempfile.mkdtemp(prefix="gl-heads-")
    for name, text in (("a", "reservation_id,roomnights,memberid\n1,2,m\n2,x,n\n"), ("b", "memberid,reservation_id\no,3\n"),
                       ("c", "memberid,reservation_id\np,4\n"), ("d", ""), ("e", "roomnights,reservation_id,memberid\n"),
                       ("f", '"resort_id","reservation_id"\n"R,1",5\n')):
        with open(os.path.join(d, f"{name}.csv"), "w") as f:
            f.write(text)
    got = {r.reservation_id: (r.roomnights, r.memberid, r.resort_id, r.bad) for r in read_bookings(spark, d, bad_col="bad").collect()}
    assert got == {"1": (2, "m", None, 0), "2": (None, "n", None, 1), "3": (None, "o", None, 0), "4": (None, "p", None, 0), "5": (None, None, "R,1", 0)}
    with open(os.path.join(d, "g.csv"), "w") as f:
        f.write("nobody_knows\n1\n")
    with pytest.raises(ValueError, match="nobody_knows"):
        read_bookings(spark, d)


def test_even_folds(spark):
    df = spark.range(0, 3000).select(F.col("id"), F.when(F.col("id") % 97 < 95, (F.col("id") * F.col("id")) % 97).alias("m"))
    out = even_folds(df, "m", 10, 5)
    sizes = sorted(r.n for r in out.where("m is not null").groupBy("fold").agg(F.countDistinct("m").alias("n")).collect())
    assert out.count() == 3000 and len(sizes) == 10 and sizes[-1] - sizes[0] <= 1
    assert out.groupBy("m").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
    assert out.where("m is null and fold is not null").count() == 0
    assert sorted(out.select("id", "fold").collect()) == sorted(even_folds(df.repartition(7), "m", 10, 5).select("id", "fold").collect())
    assert even_folds(df, "m", 10, 6).exceptAll(out).count() > 0


def test_missing_values_of_many_columns(spark):
    """More columns than one aggregate takes, and than one method reads."""
    n = 150
    df = spark.range(0, 40).select("id", *[F.when((F.col("id") + i) % 7 != 0, F.col("id") * (i + 1) - 50).cast(["double", "int", "long"][i % 3]).alias(f"c{i}") for i in range(n)])
    cols = [f"c{i}" for i in range(n)]
    plan = fit_missing(df, cols)
    rows = {r.id: r for r in df.collect()}
    assert plan.fills == {c: min(r[c] for r in rows.values() if r[c] is not None) - 1.0 for c in cols} and plan.flagged == tuple(cols)
    for r in assemble(df, cols, ["id"], plan).collect():
        got = rows[r.id]
        assert r.features.toArray().tolist() == [plan.fills[c] if got[c] is None else got[c] for c in cols] + [float(got[c] is None) for c in cols]
    assert fit_missing(df, []).fills == {}


def test_fit_partitions_follow_the_values(spark):
    from grainline.operators.boosting import BoostParams, fit_partitions
    from pyspark.ml.linalg import Vectors
    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 400, ["features"])
    assert fit_partitions(df, BoostParams(partition_rows=1)) == 2 * cores      # narrow rows: not one task per row
    assert fit_partitions(df, BoostParams(partition_rows=400)) == 1
    assert fit_partitions(df, BoostParams(partition_rows=1, partition_values=4)) == max(200, 2 * cores)


def test_reservations_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    """Joins of the tables hold about as many orders a task, whatever the session's partitions."""
    from grainline import session as S
    from grainline.sources.tables import tagged_bookings
    monkeypatch.setattr(S, "PARTITION_ROWS", 10)
    save = lambda df, name: df.write.parquet(f"{tmp_path}/{name}.parquet")
    save(spark.range(400).selectExpr("id as o_orderkey", "if(id % 10 = 3, null, if(id < 200, 1, id % 50)) as o_custkey", "'F' as o_orderstatus", "100D as o_totalprice",
                                     "timestamp'2020-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority"), "orders")
    save(spark.range(45).selectExpr("id as c_custkey", "int(id % 3) as c_nationkey", "1D as c_acctbal", "if(id % 2 = 0, 'HOUSEHOLD', 'BUILDING') as c_mktsegment"), "customer")
    save(spark.range(3).selectExpr("int(id) as n_nationkey", "int(id) as n_regionkey"), "nation")
    save(spark.range(1200).selectExpr("if(id % 100 = 99, null, id div 4) as l_orderkey", "timestamp'2020-02-01' as l_shipdate", "2D as l_quantity", "'R' as l_returnflag", "id % 5 as l_suppkey"), "lineitem")
    out = tagged_bookings(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= 40
    got = {r.reservation_id: r for r in out.collect()}
    assert len(got) == 400
    for i, r in got.items():
        cust = None if i % 10 == 3 else 1 if i < 200 else i % 50
        lines = sum(1 for x in range(1200) if x // 4 == i and x % 100 != 99)
        assert r.memberid == cust and r.room_type_booked_code == (min(lines, 6) or 6)
        assert r.member_age_buckets == (None if cust is None or cust >= 45 else "BUILDING" if cust % 2 else "HOUSEHOLD")


def test_trees_are_those_of_the_spark_learner(spark, model_data):
    """Without draws the folds' fits side by side and GBTRegressor agree."""
    params = BoostParams(max_rounds=8, first_rounds=4, patience=1, min_rows_per_leaf=5, learning_rate=0.3, subsample=1.0, feature_fraction="all")
    res = cross_validate(model_data, model_data.select("id", "features"), "id", "y", params, k=3, feature_names=["x1", "x2"])
    fold = res.folds[1]
    dev, val = fold_split(model_data, 1)
    ml = fit_selected(dev, val, "y", params)
    assert (fold["best_rounds"], fold["fitted_rounds"]) == (ml.rounds, ml.fitted) and np.allclose(fold["curve"], ml.curve, rtol=1e-9)
    numbers = lambda df: [r.prediction for r in df.orderBy("id").collect()]
    assert np.allclose(numbers(res.oof.where("fold = 1")), numbers(predict_rounds(ml.model, val)), rtol=1e-9)
    whole = fit_boosted(model_data, "y", params, 8, seed=2018)
    refits = [numbers(predict_rounds(whole, model_data, f["best_rounds"])) for f in res.folds]
    assert np.allclose(numbers(res.test), np.mean(refits, axis=0), rtol=1e-9)
    with pytest.raises(Exception, match="NULL"):
        cross_validate(model_data.withColumn("y", F.when(F.col("id") != 3, F.col("y"))), None, "id", "y", params, k=3)


def test_folds_share_the_jobs_of_a_round(spark):
    """More folds take few more jobs, longer budgets go on from the trees there are."""
    rows = spark.range(480).select("id", (F.col("id") % 6).cast("int").alias("f6"), (F.col("id") % 2).cast("int").alias("f2"),
                                   (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 13 * 2.0 + F.col("id") % 3).alias("y"))
    last_job = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    jobs = {}
    for k, first in ((2, 8), (6, 8), (2, 2)):
        data = assemble(rows.withColumn("fold", F.col(f"f{k}")), ["x"], keep=["id", "fold", "y"])
        params = BoostParams(max_rounds=8, first_rounds=first, patience=8, min_rows_per_leaf=5, max_depth=3, learning_rate=0.1)
        before = last_job()
        res = cross_validate(data, None, "id", "y", params, k=k, parallelism=1)
        jobs[k, first] = last_job() - before
        assert [f["fitted_rounds"] for f in res.folds] == [8] * k and res.oof.count() == 480
    assert jobs[6, 8] - jobs[2, 8] < 4 * 8 and jobs[2, 2] - jobs[2, 8] < 3 * 8, jobs


def test_learners_count_their_own_rows(spark, model_data):
    from grainline.operators.histograms import Growth, Learner
    params = BoostParams(min_rows_per_leaf=5, subsample=0.7, feature_fraction="0.5", max_depth=2)
    learners = [Learner(0, 0), Learner(0, 2), Learner(7)]
    g = Growth(model_data, "y", params, learners, fold_col="fold")
    g.grow(7)                       # past the rounds after which predictions are written
    g.grow(8, [1, 2], last=True)    # the first is settled
    rows = [model_data.where(f"fold != {x.held_out}").count() if x.held_out is not None else 600 for x in learners]
    for trees, n, m in zip(g.trees, rows, (7, 8, 8)):
        assert len(trees) == m and all(0.55 * n < t.stats[0, 0] < 0.85 * n for t in trees)
        assert all(abs(t.stats[1:3, 0].sum() - t.stats[0, 0]) < 1e-9 for t in trees if t.feature[0] >= 0)
        assert len({t.feature[0] for t in trees}) == 2 and len({t.stats[0, 0] for t in trees}) > 1
    assert [len(e) for e in g.errors] == [7, 8, 0] and g.errors[1][-1] < g.errors[1][0]
    g.close()
