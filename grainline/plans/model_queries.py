"""Model queries.

One cross-validation run per session and input folder is shared by those of
the full model: member-grouped folds, rounds chosen on each fold's validation
curve, refit on all train rows with the fold's round count, test predictions
averaged over the refits, and the split/gain report per fold and stage.
Bagging and feature sampling are drawn by the learner, so these get the
rows-only check.  The ``*_values`` queries run the same code on six columns with
neither drawn (every row, every column), and plain SQL fits the same trees
again: predictions, chosen rounds, gains and errors are compared by value.
"""

from __future__ import annotations

import threading

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.operators.boosting import (
    BoostParams, assemble, cross_validate, fit_boosted, fit_missing, fit_selected, node_table, predict_rounds)
from grainline.operators.folds import FOLD_COL, fold_split, group_kfold, percent_of_total, top_k
from grainline.plans import bookings as B
from grainline.plans.queries import FOLD_SEED, N_FOLDS, _memo, prepared, round6, sequenced
from grainline.session import materialize, stage_path
from grainline.sources.bookings import ID_COL, MEMBER_COL, TARGET_COL
from grainline.sources.sinks import write_importance
from grainline.sources.tables import load_table

# The library's defaults: up to 200 rounds, chosen by the validation rows.
QUERY_PARAMS = BoostParams()

_cv_lock = threading.RLock()


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "features",
                 lambda: materialize(B.group_features(sequenced(spark, sf_dir)), "features"))


def model_inputs(spark: SparkSession, sf_dir: str):
    """(train: id, fold, label, features), (test: id, features), names."""
    def build():
        feats = feature_table(spark, sf_dir)
        names = B.feature_columns(feats)
        # one pass: assemble train and test rows together, split by filter
        folded = group_kfold(feats, MEMBER_COL, N_FOLDS, FOLD_SEED).withColumn(
            FOLD_COL, F.when(F.col("train_set") == 1, F.col(FOLD_COL)))
        xy = materialize(assemble(folded, names, keep=[ID_COL, "train_set", FOLD_COL, TARGET_COL],
                                  fill=fit_missing(folded, names, indicators=False)), "model_x")
        train = xy.where(F.col("train_set") == 1).drop("train_set")
        test = xy.where(F.col("train_set") == 0).select(ID_COL, "features")
        return train, test, names
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "model_inputs")
    return _memo_obj(key, build)


_objs: dict = {}


def _memo_obj(key, build):
    with _cv_lock:
        if key not in _objs:
            _objs[key] = build()
        return _objs[key]


def cv_result(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "cv")

    def build():
        train, test, names = model_inputs(spark, sf_dir)
        return cross_validate(train, test, ID_COL, TARGET_COL, QUERY_PARAMS, N_FOLDS,
                              parallelism=8, feature_names=names)
    return _memo_obj(key, build)


def q_boosted_fit(spark, sf_dir):
    """One model, its rounds chosen by the rows of fold 0; test predictions."""
    train, test, _ = model_inputs(spark, sf_dir)
    chosen = fit_selected(*fold_split(train, 0), TARGET_COL, QUERY_PARAMS)
    return predict_rounds(chosen.model, test).select(ID_COL, "prediction")


def q_oof_predictions(spark, sf_dir):
    return cv_result(spark, sf_dir).oof


def q_oof_coverage(spark, sf_dir):
    """Every train row has one out-of-fold prediction, from its own fold."""
    oof = cv_result(spark, sf_dir).oof
    return oof.groupBy(ID_COL, FOLD_COL).agg(round6(F.max(TARGET_COL)).alias("label"), F.count("prediction").alias("n_predictions"))


def q_refit_average(spark, sf_dir):
    return cv_result(spark, sf_dir).test


def q_refit_coverage(spark, sf_dir):
    """Every test row has the mean of all folds' refits."""
    return cv_result(spark, sf_dir).test.select(ID_COL, "n_models", F.col("prediction").isNotNull().alias("predicted"))


def q_feature_importance(spark, sf_dir):
    """A row per fold, stage and feature."""
    return cv_result(spark, sf_dir).importance


def _rounds_table(spark, result):
    """A row per fold: rounds kept and fitted, validation RMSE with those
    kept, and with all that were fitted."""
    rows = [(f["fold"], f["best_rounds"], f["fitted_rounds"], f["rmse"], f["curve"][-1]) for f in result.folds]
    return spark.createDataFrame(rows, f"{FOLD_COL} int, best_rounds int, fitted_rounds int, rmse double, last_rmse double")


def q_cv_rounds(spark, sf_dir):
    return _rounds_table(spark, cv_result(spark, sf_dir))


#: Columns of few values (candidate thresholds are the midpoints), and a learner
#: that draws nothing; its step is large, so that the folds keep different rounds.
VALUE_COLS = ("room_type_booked_code", "bk_wday", "bk_month", "state_code_residence")
VALUE_PARAMS = BoostParams(max_rounds=4, first_rounds=2, patience=1, max_depth=2, learning_rate=0.8, subsample=1.0, feature_fraction="all")


def values_result(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "values")

    def build():
        rows = group_kfold(prepared(spark, sf_dir), MEMBER_COL, N_FOLDS, FOLD_SEED)
        xy = materialize(assemble(rows, VALUE_COLS, keep=[ID_COL, "train_set", FOLD_COL, TARGET_COL]), "values_x")
        train = xy.where("train_set = 1").drop("train_set")
        test = xy.where("train_set = 0").select(ID_COL, "features")
        return cross_validate(train, test, ID_COL, TARGET_COL, VALUE_PARAMS, N_FOLDS, parallelism=8, feature_names=VALUE_COLS)
    return _memo_obj(key, build)


def q_oof_values(spark, sf_dir):
    return values_result(spark, sf_dir).oof.select(ID_COL, FOLD_COL, round6("prediction").alias("prediction"))


def q_refit_values(spark, sf_dir):
    return values_result(spark, sf_dir).test.select(ID_COL, round6("prediction").alias("prediction"), "n_models")


def q_importance_values(spark, sf_dir):
    return values_result(spark, sf_dir).importance.select(FOLD_COL, "stage", "feature", "split", *[round6(c).alias(c) for c in ("gain_sum", "gain")])


def q_cv_rounds_values(spark, sf_dir):
    t = _rounds_table(spark, values_result(spark, sf_dir))
    return t.select(FOLD_COL, "best_rounds", "fitted_rounds", *[round6(c).alias(c) for c in ("rmse", "last_rmse")])


def q_written_importance(spark, sf_dir):
    """Gain of each column in all folds' refits, written by the sink as CSV,
    read back and ranked."""
    path = stage_path(spark, "importance")
    refit = values_result(spark, sf_dir).importance.where("stage = 'refit'")
    total = refit.groupBy("feature").agg(F.sum("split").alias("split"), F.sum("gain_sum").alias("gain_sum"))
    write_importance(percent_of_total(total, "gain_sum", "gain"), path)
    back = spark.read.option("header", True).schema("feature string, split long, gain_sum double, gain double").csv(path)
    ranked = top_k(back, "gain", 25, tie=["feature"])
    return ranked.select("feature", "split", round6("gain_sum").alias("gain_sum"), round6("gain").alias("gain"))


#: Columns of few values, so that their candidate thresholds are the midpoints.
STUMP_COLS = ("channel_code", "main_product_code", "resort_region_code", "room_type_booked_code")


def q_assemble_matrix(spark, sf_dir):
    """The filled values of some columns with and without NULLs, per row."""
    cols = ["checkin_ord", "child_per_adult", "pax_per_night", *STUMP_COLS]
    xy = assemble(prepared(spark, sf_dir), cols, keep=[ID_COL])
    arr = vector_to_array("features")
    return xy.select(ID_COL, *[round6(arr[i]).alias(f"x_{c}") for i, c in enumerate(cols)])


def q_assemble_missing(spark, sf_dir):
    """Fills below each column's own range, and indicators: balances go below
    -999, some are missing; nation keys have none missing."""
    c = load_table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_acctbal") * 10).alias("balance"), "c_nationkey",
                    F.when(F.col("c_mktsegment") == "BUILDING", F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("other"))
    cols = ["balance", "c_nationkey", "other"]
    plan = fit_missing(rows, cols)
    arr = vector_to_array(F.col("features"))
    return assemble(rows, cols, keep=["c_custkey"], fill=plan).select("c_custkey", *[round6(arr[i]).alias(f"x_{n}") for i, n in enumerate(plan.names(cols))])


def q_stump_split(spark, sf_dir):
    """One round of depth one: the split that lowers the variance most."""
    train = prepared(spark, sf_dir).where(F.col("train_set") == 1)
    xy = materialize(assemble(train, STUMP_COLS, keep=[TARGET_COL]), "stump")
    model = fit_boosted(xy, TARGET_COL, BoostParams(max_rounds=1, max_depth=1, subsample=1.0, feature_fraction="all", min_rows_per_leaf=1))
    n = node_table(model, spark).select("nodeData.*")
    root, leaf = n.where("id = 0"), lambda i, c: n.where(f"id = {i}").select(F.col("prediction").alias(c))
    names = F.array(*[F.lit(c) for c in STUMP_COLS])
    one = root.select(names[F.col("split.featureIndex")].alias("feature"), F.col("split.leftCategoriesOrThreshold")[0].alias("threshold"))
    left, right = leaf(1, "l").first()[0], leaf(2, "r").first()[0]  # one number each
    return one.withColumns({"mean_left": round6(F.lit(left)), "mean_right": round6(F.lit(right))})


MODEL_QUERIES = {
    "assemble_matrix": q_assemble_matrix,
    "assemble_missing": q_assemble_missing,
    "stump_split": q_stump_split,
    "boosted_fit": q_boosted_fit,
    "oof_predictions": q_oof_predictions,
    "oof_coverage": q_oof_coverage,
    "refit_average": q_refit_average,
    "refit_coverage": q_refit_coverage,
    "feature_importance": q_feature_importance,
    "cv_rounds": q_cv_rounds,
    "oof_values": q_oof_values,
    "refit_values": q_refit_values,
    "importance_values": q_importance_values,
    "cv_rounds_values": q_cv_rounds_values,
    "written_importance": q_written_importance,
}
