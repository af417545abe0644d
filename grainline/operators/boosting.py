"""Gradient-boosted regression trees with group-wise cross validation,
early stopping, refit and ensemble averaging; models are Spark ML's.

* A single fit is ``pyspark.ml.regression.GBTRegressor`` (distributed
  histogram search per level).  The fits of a cross validation grow side by side
  with the same steps on rows binned once (``operators.histograms``); where
  ``extra`` sets more of that learner, it fits them too.  Both grow level-wise, so
  ``max_depth`` also caps the leaf count; no L1/L2 leaf penalty (documented gap).
* Rounds are chosen on the whole validation curve: a budget of rounds is
  fitted on the dev rows, the loss on the validation rows is taken
  after every round, and the model keeps the rounds up to the smallest loss.
  If that lies within the last ``patience`` rounds the budget is doubled (up to
  ``max_rounds``): the longer fit starts with the same trees (side by side,
  growth goes on from them).
* A model of fewer rounds is the same model with fewer trees, so it predicts
  in one transform.
* Folds come from ``group_kfold`` (a column), so dev/val rows are filters.
* Fold predictions run concurrently from a driver thread pool (as
  ``CrossValidator(parallelism=...)`` does).
"""

from __future__ import annotations

import concurrent.futures as cf
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import SparkContext
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.operators.folds import FOLD_COL, fold_split, mean_of_columns, rmse
from grainline.operators.histograms import Growth, Learner
from grainline.session import ensure_checkpoint_dir, materialize, stage_path

FEATURES_COL = "features"
MISSING_FILL = -999.0
# Columns of one aggregate of ``fit_missing``.
FIT_COLUMNS = 32


@dataclass(frozen=True)
class BoostParams:
    """Learner settings.  Fixed values where Spark has an equivalent: min
    rows per leaf 150, bagging 0.7, feature share 0.7.  Depth 4 stands for a
    cap of 15 leaves, 32 bins bound the histograms; the learning rate is
    larger because Spark fits far fewer rounds.  ``first_rounds``: the first
    budget; ``patience``: rounds without gain at its end that settle it."""
    max_rounds: int = 200
    first_rounds: int = 40
    patience: int = 10
    max_depth: int = 4
    min_rows_per_leaf: int = 150
    learning_rate: float = 0.2
    subsample: float = 0.7
    feature_fraction: str = "0.7"
    max_bins: int = 32
    seed: int = 0
    partition_rows: int = 25_000   # a round is a job per level: few rows a task are all overhead
    partition_values: int = 10_000_000   # feature values of a partition once all cores have one
    extra: dict = field(default_factory=dict)

    def estimator(self, label: str, features: str = FEATURES_COL,
                  rounds: int | None = None, seed: int | None = None) -> GBTRegressor:
        est = GBTRegressor(
            featuresCol=features, labelCol=label, lossType="squared",
            maxIter=rounds or self.max_rounds, maxDepth=self.max_depth,
            minInstancesPerNode=self.min_rows_per_leaf, stepSize=self.learning_rate,
            subsamplingRate=self.subsample, featureSubsetStrategy=self.feature_fraction,
            maxBins=self.max_bins, seed=self.seed if seed is None else seed,
            checkpointInterval=10)
        if self.extra:
            est = est.setParams(**self.extra)
        return est


@dataclass(frozen=True)
class MissingPlan:
    """What stands for a missing value of each column, and the columns that
    have any; fitted once, so that later rows are filled alike."""
    fills: dict[str, float]
    flagged: tuple[str, ...]

    def names(self, features: Sequence[str]) -> list[str]:
        """Vector positions: the features, then the indicators."""
        return [*features, *[f"{c}__missing" for c in self.flagged if c in set(features)]]


def _known(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def fit_missing(df: DataFrame, features: Sequence[str], indicators: bool = True) -> MissingPlan:
    """A fill below each column's smallest value (by 1, or a millionth of it if
    that is more; 0 for a column without values), and with ``indicators`` the
    columns that have missing values.  One job of aggregates over
    ``FIT_COLUMNS`` columns each, so their code fits into compiled methods; each
    reads its own columns alone, so a written ``df`` is read once in all."""
    features = list(features)
    slices = [features[i:i + FIT_COLUMNS] for i in range(0, len(features), FIT_COLUMNS)]
    if not slices:
        return MissingPlan({}, ())
    parts = [df.agg(F.array(*[F.min(_known(_double(c))) for c in cs]).alias("low"), F.array(*[F.count(_known(_double(c))) for c in cs]).alias("known"),
                    F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("slice"), "low", "known", "rows") for i, cs in enumerate(slices)]
    low, missing = {}, set()
    for r in reduce(DataFrame.unionByName, parts).collect():  # a row per slice of columns
        low.update(zip(slices[r["slice"]], r["low"]))
        missing.update(c for c, n in zip(slices[r["slice"]], r["known"]) if n < r["rows"])
    fills = {c: 0.0 if low[c] is None else low[c] - max(1.0, abs(low[c]) * 1e-6) for c in features}
    return MissingPlan(fills, tuple(c for c in features if indicators and c in missing))


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (),
             fill: float | MissingPlan = MISSING_FILL, out: str = FEATURES_COL) -> DataFrame:
    """``keep`` columns plus one vector column.  The tree learner rejects
    NaN, so NULL / NaN become ``fill``: one value, or each column's own value
    below its range (``fit_missing``), with an indicator (1 = missing) per
    flagged column after the features."""
    # the fills meet the values inside one array: the same expression written
    # out for hundreds of columns outgrows a compiled method
    plan = fill if isinstance(fill, MissingPlan) else MissingPlan(dict.fromkeys(features, fill), ())
    values = F.array(*[_double(c) for c in features])
    vector = F.zip_with(values, F.lit([float(plan.fills[c]) for c in features]), lambda x, f: F.coalesce(_known(x), f))
    flagged = [_double(c) for c in plan.flagged if c in set(features)]
    if flagged:
        vector = F.concat(vector, F.transform(F.array(*flagged), lambda x: _known(x).isNull().cast("double")))
    return df.select(*keep, array_to_vector(vector).alias(out))


def fit_partitions(df: DataFrame, params: BoostParams = BoostParams(), features: str = FEATURES_COL, learners: int = 1) -> int:
    """Partitions of ``partition_rows`` rows (divided among the ``learners`` that are
    fitted side by side) until all cores have two; more only
    for more than ``partition_values`` feature values in each, so that the tasks
    of a job (one per tree level) follow the work and not the rows."""
    rows = df.count()
    first = df.select(features).head(1)
    width = len(first[0][0]) if first and first[0][0] is not None else 1
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(math.ceil(rows * learners / params.partition_rows), cores), math.ceil(rows * width / params.partition_values))


def _model(growth: Growth, learner: int, features: str, rounds: int | None = None) -> GBTRegressionModel:
    """The first ``rounds`` trees of a learner (all without) as Spark's model.  The squares
    in a leaf are not summed: its impurity is given as 0."""
    sc = SparkContext._active_spark_context
    jvm, ml = sc._jvm, sc._jvm.org.apache.spark.ml
    impurity = getattr(jvm.org.apache.spark.mllib.tree.impurity, "VarianceCalculator")
    trees = growth.trees[learner][:rounds]
    java = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = sc._gateway.new_array(jvm.double, len(trees))
    uid = f"GBTRegressor_{uuid.uuid4().hex[:12]}"
    for i, tree in enumerate(trees):
        stats = _py2java(sc, DenseVector(tree.stats.ravel())).values()

        def node(v: int):
            n, total, squares = (float(x) for x in tree.stats[v])
            of = impurity(jvm.java.util.Arrays.copyOfRange(stats, 3 * v, 3 * v + 3), int(n))
            f, value = int(tree.feature[v]), total / n if n else 0.0
            spread = max(0.0, squares / n - value * value) if n else 0.0
            if f < 0:
                return ml.tree.LeafNode(value, spread, of)
            split = ml.tree.ContinuousSplit(f, float(growth.cuts[f][tree.cut[v]]))
            return ml.tree.InternalNode(value, spread, float(tree.gain[v]), node(2 * v + 1), node(2 * v + 2), split, of)
        java[i] = ml.regression.DecisionTreeRegressionModel(f"{uid}_{i}", node(0), growth.width)
        weights[i] = tree.weight
    model = ml.regression.GBTRegressionModel(uid, java, weights, growth.width)
    model.setFeaturesCol(features)
    return GBTRegressionModel(model)


def fit_boosted(df: DataFrame, label: str, params: BoostParams = BoostParams(),
                rounds: int | None = None, seed: int | None = None,
                features: str = FEATURES_COL) -> GBTRegressionModel:
    """Fit all ``rounds`` (the budget ``max_rounds`` without) on ``df``."""
    ensure_checkpoint_dir(df.sparkSession)   # checkpoints of the running predictions
    df = df.coalesce(fit_partitions(df, params, features))
    return params.estimator(label, features, rounds, seed).fit(df)


@dataclass
class Selection:
    model: GBTRegressionModel   # of the chosen rounds
    rounds: int
    fitted: int                 # rounds of the last budget
    curve: list[float]          # validation RMSE after each fitted round (none without rows)


def _settled(curve: Sequence[float], budget: int, params: BoostParams) -> int | None:
    """The round with the smallest loss (the first of equal ones), unless the
    next budget may have a better one."""
    best = curve.index(min(curve)) + 1
    return best if budget >= params.max_rounds or best + params.patience <= budget else None


def _grow_selected(growth: Growth, params: BoostParams) -> dict[int, tuple[int, int]]:
    """Grow until every learner that leaves out a fold is settled: its rounds
    kept and fitted.  Learners of all rows get as many as the longest."""
    budget, chosen = min(params.first_rounds, params.max_rounds), {}
    held = [i for i, x in enumerate(growth.learners) if x.held_out is not None]
    while len(chosen) < len(held):
        growth.grow(budget, [i for i in range(len(growth.learners)) if i not in chosen], last=budget >= params.max_rounds)
        for i in held:
            best = None if i in chosen else _settled(growth.errors[i], budget, params)
            if best is not None:
                chosen[i] = best, budget
        budget = min(2 * budget, params.max_rounds)
    return chosen


def fit_selected(dev: DataFrame, val: DataFrame, label: str, params: BoostParams = BoostParams(),
                 features: str = FEATURES_COL) -> Selection:
    """Fit on ``dev`` and keep the rounds with the smallest loss on ``val``
    (the first of equal ones).  Without validation rows all of the first
    budget are kept."""
    budget = min(params.first_rounds, params.max_rounds)
    if val.isEmpty():
        return Selection(fit_boosted(dev, label, params, budget, features=features), budget, budget, [])
    while True:
        model = fit_boosted(dev, label, params, budget, features=features)
        curve = [math.sqrt(x) for x in model.evaluateEachIteration(val.select(label, features), "squared")]
        best = _settled(curve, budget, params)
        if best is not None:
            return Selection(truncated(model, best), best, budget, curve)
        budget = min(2 * budget, params.max_rounds)


def truncated(model: GBTRegressionModel, n: int | None) -> GBTRegressionModel:
    """The model of the first ``n`` trees (the model itself for None)."""
    trees = model._java_obj.trees()
    if n is None or n >= len(trees):
        return model
    sc = SparkContext._active_spark_context
    package = sc._jvm.org.apache.spark.ml.regression
    first = sc._gateway.new_array(package.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, w in enumerate(model.treeWeights[:n]):
        first[i], weights[i] = trees[i], float(w)
    java = package.GBTRegressionModel(model.uid, first, weights, model.numFeatures)
    java.setFeaturesCol(model.getFeaturesCol())
    return GBTRegressionModel(java)


def predict_rounds(model: GBTRegressionModel, df: DataFrame, n: int | None = None,
                   out: str = "prediction") -> DataFrame:
    """Prediction of the first ``n`` trees (all when ``n`` is None)."""
    return truncated(model, n).copy().setPredictionCol(out).transform(df)


def node_table(model: GBTRegressionModel, spark: SparkSession) -> DataFrame:
    """The model's nodes, one row each, as Spark writes them."""
    path = stage_path(spark, "model")
    model.write().session(spark).overwrite().save(path)
    return spark.read.parquet(f"{path}/data")


def importance(model: GBTRegressionModel, feature_names: Sequence[str], spark: SparkSession,
               n_trees: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Per feature: number of splits and summed gain (plus gain percent),
    read from the model's saved node table (``nodes`` if there is one)."""
    nodes = node_table(model, spark) if nodes is None else nodes
    if n_trees is not None:
        nodes = nodes.where(F.col("treeID") < n_trees)
    splits = (nodes.where(F.col("nodeData.leftChild") >= 0)
              .select(F.col("nodeData.split.featureIndex").alias("feature_index"),
                      F.col("nodeData.gain").alias("gain")))
    agg = splits.groupBy("feature_index").agg(F.count(F.lit(1)).alias("split"),
                                               F.sum("gain").alias("gain_sum"))
    names = spark.createDataFrame(list(enumerate(feature_names)), "feature_index int, feature string")
    rep = names.join(agg, "feature_index", "left").fillna({"split": 0, "gain_sum": 0.0})
    total = rep.agg(F.sum("gain_sum")).first()[0] or 0.0
    return rep.withColumn("gain", F.try_divide(F.col("gain_sum") * F.lit(100.0),
                                               F.lit(float(total)) if total else F.lit(None).cast("double")))


@dataclass
class CVResult:
    oof: DataFrame            # id, fold, label, prediction (validation rows)
    test: DataFrame           # id, prediction (mean of refits), n_models
    folds: list[dict]         # fold, best_rounds, fitted_rounds, rmse, curve
    importance: DataFrame | None = None   # fold, stage, feature, split, gain_sum, gain


def cross_validate(train: DataFrame, test: DataFrame | None, id_col: str, label: str,
                   params: BoostParams = BoostParams(), k: int = 10,
                   fold_col: str = FOLD_COL, refit_seed: int = 2018, parallelism: int = 4,
                   feature_names: Sequence[str] | None = None) -> CVResult:
    """Group-wise CV: for each fold fit on dev, choose the rounds on val and
    predict val; refit on all train rows and predict test with each fold's
    round count; average those predictions.

    All refits use the same rows and seed and differ only in the number of
    trees, and a fit with fewer rounds is a prefix of a longer one
    (tested), so one refit with the largest count serves every fold.  It grows
    beside the folds' fits, on the same binned rows.  The
    importance report has a row per feature for each fold and stage (``dev``:
    the fold's fit, ``refit``: the refit with the fold's rounds).

    ``train`` holds ``id_col, fold_col, label, features``; ``test`` holds
    ``id_col, features``.  Both should be materialised."""
    spark = train.sparkSession
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect() if r[0] is not None)

    def report(model, fold, stage, n=None, nodes=None):
        rep = importance(model, feature_names, spark, n, nodes)
        return rep.select(F.lit(fold).alias(fold_col), F.lit(stage).alias("stage"), "feature", "split", "gain_sum", "gain")

    refits = test is not None or feature_names is not None
    growth, refit = None, None
    if not params.extra:
        learners = [Learner(params.seed, f) for f in folds] + [Learner(refit_seed)] * refits
        growth = Growth(train, label, params, learners, FEATURES_COL, fold_col, partitions=fit_partitions(train, params, learners=len(learners)))
        kept = _grow_selected(growth, params)
        growth.close()

    def one(i: int):
        f = folds[i]
        dev, val = fold_split(train, f, fold_col)
        chosen = fit_selected(dev, val, label, params) if growth is None else Selection(
            _model(growth, i, FEATURES_COL, kept[i][0]), *kept[i], growth.errors[i])
        val_pred = materialize(predict_rounds(chosen.model, val).select(id_col, fold_col, label, "prediction"), "oof")
        score = rmse(val_pred, label, "prediction").first()["rmse"]
        summary = {"fold": f, "best_rounds": chosen.rounds, "fitted_rounds": chosen.fitted, "rmse": score, "curve": chosen.curve}
        return summary, val_pred, report(chosen.model, f, "dev") if feature_names is not None else None

    with cf.ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(one, range(len(folds))))

    oof = reduce(DataFrame.unionByName, [r[1] for r in results])
    best = {r[0]["fold"]: r[0]["best_rounds"] for r in results}
    test_avg, imp = None, None
    if refits:
        rounds = max(best.values())
        refit = fit_boosted(train, label, params, rounds, refit_seed) if growth is None else _model(growth, len(folds), FEATURES_COL, rounds)
        if test is not None:
            cur = test
            for f, n in best.items():
                cur = predict_rounds(refit, cur, n, f"_p{f}")
            test_avg = mean_of_columns(cur, [f"_p{f}" for f in best]).select(id_col, "prediction", "n_models")
        if feature_names is not None:
            nodes = node_table(refit, spark)
            imp = reduce(DataFrame.unionByName, [r[2] for r in results] + [report(refit, f, "refit", n, nodes) for f, n in best.items()])
    return CVResult(oof=oof, test=test_avg,
                    folds=[r[0] for r in results],
                    importance=imp)
