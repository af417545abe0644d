"""Registered queries: one per operator of the coverage list, each reading
the test tables (through the reservation fixture) and returning a
DataFrame whose columns match the DuckDB oracle in ``grainline.oracle``.

Stage tables (prepared reservations, sequences) are written once per
session and input folder and reused by later queries.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.functions.dates import parse_dates
from grainline.operators.cleaning import split_source
from grainline.operators.explore import (
    describe_by, frequency_compare, key_overlap, merge_sketches, profile_nulls, profile_schema, quantile_sketch, sketch_error,
    sketch_quantiles, visits_per_entity)
from grainline.operators.folds import (
    FOLD_COL, cv_report, even_folds, fold_members, fold_split, group_kfold, mean_of_columns,
    percent_of_total, top_k)
from grainline.operators.group_back import CountBy, StatsBy, group_back, output_names
from grainline.operators.group_state import apply_states, fit_states, group_back_fitted, merge_states, out_of_fold
from grainline.operators.sequence import Order, gap_name, sequence_shift, shift_name
from grainline.plans import bookings as B
from grainline.plans import manifest as M
from grainline.session import materialize, stage_path
from grainline.sources.bookings import DATE_COLS, ID_COL, MEMBER_COL, RAW_COLUMNS, TARGET_COL, read_bookings
from grainline.sources.sinks import write_predictions
from grainline.sources.tables import load_table, tagged_bookings

_lock = threading.RLock()
_stages: dict = {}

N_FOLDS = 10
FOLD_SEED = 2017


def _memo(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    with _lock:
        if key not in _stages:
            _stages[key] = build()
        return _stages[key]


def clean_union(spark, sf_dir) -> DataFrame:
    return B.clean_tagged(tagged_bookings(spark, sf_dir))


def prepared(spark, sf_dir) -> DataFrame:
    return _memo(spark, sf_dir, "prepared",
                 lambda: B.prepare_tagged(tagged_bookings(spark, sf_dir)))


def sequenced(spark, sf_dir) -> DataFrame:
    return _memo(spark, sf_dir, "sequences", lambda: B.sequences(prepared(spark, sf_dir)))


def round6(c) -> F.Column:
    """Round to 6 decimals for the oracle comparison.  First snap to 9
    decimals: means that sit exactly on a 7th-decimal half (1027/640) differ
    between engines only in the last bit, which the snap removes before the
    half-even rounding."""
    x = F.col(c) if isinstance(c, str) else c
    snapped = F.rint(x * F.lit(1e9)) / F.lit(1e9)
    return F.rint(snapped * F.lit(1e6)) / F.lit(1e6)


def _group_query(specs):
    def q(spark, sf_dir):
        seq = sequenced(spark, sf_dir)
        out = group_back(seq.select(ID_COL, *sorted({k for s in specs for k in s.keys} |
                                                    {m for s in specs for m in
                                                     ([s.measure] if hasattr(s, "measure") else [])})),
                         specs, ID_COL)
        cols = [F.col(ID_COL)]
        for s in specs:
            for name, (stat, _) in s.outputs():
                cols.append(round6(name).alias(name) if stat in ("mean", "std") else F.col(name))
        return out.select(*cols)
    return q


# ---- scans, projections ---------------------------------------------------

def q_date_parse(spark, sf_dir):
    """Day-first text dates parsed back; malformed text -> NULL."""
    o = load_table(spark, sf_dir, "orders")
    txt = o.select(
        F.col("o_orderkey").alias(ID_COL),
        F.date_format("o_orderdate", "d/M/yyyy").alias("booked_text"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), F.col("o_orderpriority")))
        .otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("alt_text"))
    return parse_dates(txt, ["booked_text", "alt_text"]).select(
        ID_COL, F.col("booked_text").alias("booked_on"), F.col("alt_text").alias("alt_on"))


def q_calendar_parts(spark, sf_dir):
    df = B.row_features(clean_union(spark, sf_dir))
    cols = [f"{p}_{x}" for p in ("bk", "ci", "co") for x in ("year", "month", "week", "wday")]
    return df.select(ID_COL, *cols)


def q_date_gaps(spark, sf_dir):
    df = B.row_features(clean_union(spark, sf_dir))
    return df.select(ID_COL, "lead_days", "stay_days", "checkin_ord", "booking_ord")


def q_reset_invalid_rows(spark, sf_dir):
    return clean_union(spark, sf_dir).drop("train_set")


def q_source_union(spark, sf_dir):
    tr, te = split_source(materialize(clean_union(spark, sf_dir), "union"))
    # both halves of the split, re-tagged from the split itself
    return (tr.select(ID_COL, F.lit("train").alias("part"), TARGET_COL)
            .unionByName(te.select(ID_COL, F.lit("test").alias("part"), TARGET_COL)))


def q_impute_round(spark, sf_dir):
    df = B.row_features(clean_union(spark, sf_dir))
    return df.select(ID_COL, "season_holidayed_code", "state_code_residence")


def q_ratios_as_observed(spark, sf_dir):
    """The overwritten ratio (all guests per night under the party's name)."""
    df = B.row_features(clean_union(spark, sf_dir), B.BookingsConfig(as_observed=True))
    return df.select(ID_COL, "pax_per_night", "party_per_night")


def q_feature_projection(spark, sf_dir):
    """The model's columns of the prepared rows, one row per column with its
    count, so that the projection itself can be compared."""
    p = prepared(spark, sf_dir)
    cols = B.feature_columns(p)
    return profile_nulls(p.select(*cols), with_types=False).select("column_name", "rows", "nulls")


def q_schema_report(spark, sf_dir):
    """Column, type, position and null count of the cleaned rows."""
    u = clean_union(spark, sf_dir).select(*RAW_COLUMNS, "train_set")
    nulls = profile_nulls(u, with_types=False).select("column_name", "nulls")
    return profile_schema(u).drop("nullable").join(nulls, F.col("column") == F.col("column_name")).select(
        "column", "dtype", "position", "nulls")


def q_csv_roundtrip(spark, sf_dir):
    """Reservations written as CSV with day-first dates, read back by header
    name: train files have all columns in reverse order, test files lack the
    target and are sorted by name."""
    b = tagged_bookings(spark, sf_dir)
    path = stage_path(spark, "csv")
    orders = {1: list(reversed(RAW_COLUMNS)), 0: sorted(c for c in RAW_COLUMNS if c != TARGET_COL)}
    for side, cols in orders.items():
        text = b.where(F.col("train_set") == side).select(*[F.date_format(c, "d/M/yyyy").alias(c) if c in DATE_COLS else F.col(c) for c in cols])
        text.write.mode("append").option("header", True).csv(path)
    back = read_bookings(spark, path, strict=True, strict_dates=True)
    return back.withColumn(ID_COL, F.col(ID_COL).cast("long")).withColumn(MEMBER_COL, F.col(MEMBER_COL).cast("long"))


def q_written_predictions(spark, sf_dir):
    """The stand-in predictions, written by the sink and read back."""
    path = stage_path(spark, "predictions")
    write_predictions(q_average_predictions(spark, sf_dir), path, out_name="amount")
    return spark.read.parquet(path)


def q_ratios(spark, sf_dir):
    df = B.row_features(clean_union(spark, sf_dir))
    return df.select(ID_COL, *M.RATIOS)


# ---- group-back -------------------------------------------------------------

_single = M.count_specs_single()
_cross = M.count_specs_cross()
q_count_back_single = _group_query(_single)
q_count_back_pair = _group_query([s for s in _cross if len(s.keys) == 2])
q_count_back_triple = _group_query([s for s in _cross if len(s.keys) == 3])
q_count_back_wide = _group_query(M.count_specs_wide())
_party = M.stats_specs_party()
q_stats_back_single = _group_query([s for s in _party if len(s.keys) == 1])
q_stats_back_calendar = _group_query([s for s in _party if len(s.keys) == 3] + M.stats_specs_repeat())
q_stats_back_season = _group_query(M.stats_specs_season())
_derived = M.stats_specs_derived()
q_stats_back_ratio = _group_query([s for s in _derived if "ord" not in s.measure])
q_stats_back_gap = _group_query([s for s in _derived if "ord" in s.measure])


#: Statistics that are fitted on some rows and given to others.
FITTED_SPECS = [
    CountBy(("channel_code",)), CountBy(("resort_id", "ci_month")),
    StatsBy(("resort_id",), "total_pax"), StatsBy(("channel_code", "room_type_booked_code"), "pax_per_night"),
    StatsBy(("memberid",), TARGET_COL), StatsBy(("resort_id", "bk_wday"), TARGET_COL),
]


def _rounded_specs(out, specs):
    cols = [round6(name).alias(name) if stat in ("mean", "std") else F.col(name) for s in specs for name, (stat, _) in s.outputs()]
    return out.select(ID_COL, *cols)


def q_stats_back_train_only(spark, sf_dir):
    """Statistics of the train rows, for train and test rows alike."""
    return _rounded_specs(group_back_fitted(prepared(spark, sf_dir), FITTED_SPECS, "train_set = 1", ID_COL), FITTED_SPECS)


def q_stats_back_merged(spark, sf_dir):
    """The same from states of two parts of the train rows, merged."""
    p = prepared(spark, sf_dir)
    parts = [fit_states(p.where(f"train_set = 1 and {x}"), FITTED_SPECS) for x in ("bk_month <= 4", "(bk_month > 4) is not false")]
    return _rounded_specs(apply_states(p, merge_states(*parts), FITTED_SPECS, ID_COL), FITTED_SPECS)


def q_stats_back_out_of_fold(spark, sf_dir):
    """Statistics, of the target too, over the train rows of other folds; test
    rows get those of all train rows."""
    p = prepared(spark, sf_dir)
    rows = group_kfold(p, MEMBER_COL, N_FOLDS, FOLD_SEED).withColumn(FOLD_COL, F.when(F.col("train_set") == 1, F.col(FOLD_COL)))
    # members lie in one fold each, so they have no statistics of their own
    specs = [s for s in FITTED_SPECS if s.keys != (MEMBER_COL,)]
    return _rounded_specs(out_of_fold(materialize(rows, "folded"), specs, FOLD_COL, ID_COL), specs)


# ---- sequences, codes ----------------------------------------------------------

def q_visit_gaps(spark, sf_dir):
    seq = sequenced(spark, sf_dir)
    offs = list(range(1, 5)) + [-k for k in range(1, 5)]
    cols = [shift_name(c, k) for c in ("checkin_ord", "booking_ord") for k in offs]
    cols += [gap_name(c, k) for c in ("checkin_ord", "booking_ord") for k in offs]
    return seq.select(ID_COL, *cols)


def q_sequence_shift(spark, sf_dir):
    seq = sequenced(spark, sf_dir)
    offs = list(range(1, 4)) + [-k for k in range(1, 4)]
    return seq.select(ID_COL, *[shift_name(c, k) for c in M.SHIFT_ATTRS for k in offs])


#: Lines of one return flag are far above this many at every size, so the
#: query goes by ranges.
HOT_LINES = 1000


def q_sequence_shift_hot(spark, sf_dir):
    """Previous and next prices of a third of all lines in one group: lines
    per return flag by ship date and line (line numbers repeat in the test
    tables, so the shifted columns end the order)."""
    li = load_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")
    out = sequence_shift(li, "l_returnflag", ["l_extendedprice", "l_suppkey"], [1, 2, -1],
                         [Order(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")], hot_group_rows=HOT_LINES)
    return out.select("l_orderkey", "l_linenumber", *[shift_name(c, k) for c in ("l_extendedprice", "l_suppkey") for k in (1, 2, -1)])


def q_first_seen_index(spark, sf_dir):
    return prepared(spark, sf_dir).select(ID_COL, *M.CODED_COLS)


# ---- folds, metrics, ensembles --------------------------------------------------

def _train_folds(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return group_kfold(p.where(F.col("train_set") == 1), MEMBER_COL, N_FOLDS, FOLD_SEED)


def q_fold_members(spark, sf_dir):
    return fold_members(_train_folds(spark, sf_dir), MEMBER_COL)


def q_even_folds(spark, sf_dir):
    """Members dealt to the folds in turn: numbers differ by at most one."""
    p = prepared(spark, sf_dir).where(F.col("train_set") == 1)
    members = fold_members(even_folds(p, MEMBER_COL, N_FOLDS, FOLD_SEED), MEMBER_COL)
    n = members.groupBy(FOLD_COL).agg(F.count(F.lit(1)).alias("fold_members"))
    return members.join(F.broadcast(n), FOLD_COL)  # a row per fold


def q_fold_split(spark, sf_dir):
    dev, val = fold_split(_train_folds(spark, sf_dir), 3)
    return (dev.select(ID_COL, F.lit("dev").alias("side"))
            .unionByName(val.select(ID_COL, F.lit("val").alias("side"))))


def _standin_models(spark, sf_dir):
    """Deterministic stand-in model: the model of fold f predicts the mean
    target per roomnights over the dev rows of f, i.e. (total - fold part)
    / (count - fold count), and where dev has no such row the mean of all dev
    rows.  Returns train rows with folds, a table per roomnights with the
    prediction of every fold (p0, p1, ...), and the folds' dev means."""
    t = _train_folds(spark, sf_dir)
    y = F.col(TARGET_COL)
    part = lambda f: F.when(F.col(FOLD_COL) == f, y)
    sums = materialize(t.groupBy("roomnights").agg(
        F.sum(y).alias("s"), F.count(y).alias("n"),
        *[F.coalesce(F.sum(part(f)), F.lit(0.0)).alias(f"s{f}") for f in range(N_FOLDS)],
        *[F.count(part(f)).alias(f"n{f}") for f in range(N_FOLDS)]), "standin")
    row = sums.agg(*[F.try_divide(F.sum(F.col("s") - F.col(f"s{f}")), F.sum(F.col("n") - F.col(f"n{f}")).cast("double")).alias(f"m{f}")
                     for f in range(N_FOLDS)]).first()
    table = sums.select("roomnights", *[F.try_divide(F.col("s") - F.col(f"s{f}"), (F.col("n") - F.col(f"n{f}")).cast("double")).alias(f"p{f}")
                                        for f in range(N_FOLDS)])
    return t, table, [row[f"m{f}"] for f in range(N_FOLDS)]


def q_rmse_by_fold(spark, sf_dir):
    t, table, means = _standin_models(spark, sf_dir)
    rows = t.select(FOLD_COL, "roomnights", TARGET_COL).join(table.withColumnRenamed("roomnights", "_r"),
                                                            F.col("roomnights").eqNullSafe(F.col("_r")), "left")
    pick = F.coalesce(*[F.when(F.col(FOLD_COL) == f, F.coalesce(F.col(f"p{f}"), F.lit(means[f]).cast("double"))) for f in range(N_FOLDS)])
    rep = cv_report(rows.withColumn("prediction", pick), TARGET_COL, "prediction")
    return rep.select(FOLD_COL, "n_rows", *[round6(c).alias(c) for c in ("rmse", "mean_fold_rmse", "overall_rmse")])


def q_average_predictions(spark, sf_dir):
    _, table, means = _standin_models(spark, sf_dir)
    test = prepared(spark, sf_dir).where(F.col("train_set") == 0).select(ID_COL, "roomnights")
    rows = test.join(table.withColumnRenamed("roomnights", "_r"), F.col("roomnights").eqNullSafe(F.col("_r")), "left")
    rows = rows.withColumns({f"p{f}": F.coalesce(F.col(f"p{f}"), F.lit(means[f]).cast("double")) for f in range(N_FOLDS)})
    return mean_of_columns(rows, [f"p{f}" for f in range(N_FOLDS)]).select(ID_COL, round6("prediction").alias("prediction"), "n_models")


def _gain_table(spark, sf_dir):
    """Stand-in importance table: an integer total per resort (exact in
    both engines, so the percentages compare bit for bit)."""
    return prepared(spark, sf_dir).groupBy("resort_id").agg(F.sum("total_pax").alias("gain_sum"))


def q_percent_of_total(spark, sf_dir):
    g = percent_of_total(_gain_table(spark, sf_dir), "gain_sum", "gain")
    return g.select("resort_id", "gain_sum", round6("gain").alias("gain"))


def q_top_importance(spark, sf_dir):
    g = percent_of_total(_gain_table(spark, sf_dir), "gain_sum", "gain")
    return top_k(g, "gain", 25, tie=["resort_id"]).select("resort_id", round6("gain").alias("gain"))


# ---- exploration ---------------------------------------------------------------

def _describe_cols(df):
    return df.select(*[c for c in df.columns if c not in ("n", "mean", "std", "min", "max",
                                                          "p25", "p50", "p75")],
                     "n", *[round6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50",
                                                         "p75", "max")])


def q_describe_target(spark, sf_dir):
    p = prepared(spark, sf_dir).where(F.col("train_set") == 1)
    return _describe_cols(describe_by(p, TARGET_COL, ["ci_month"]))


def q_sketch_quantiles(spark, sf_dir):
    """Quantiles from merged sketches (one per booking and check-in month, added
    up per check-in month), each with the test of its true rank.  The party
    size has a handful of values, most of them tied."""
    p = prepared(spark, sf_dir).where("train_set = 1 and ci_month is not null")
    probs = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    out = None
    for col in (TARGET_COL, "total_pax"):
        parts = materialize(quantile_sketch(p, col, ["bk_month", "ci_month"]), "sketches")
        marks = sketch_quantiles(merge_sketches(parts, ["ci_month"]), probs, ["ci_month"], [f"q{i}" for i in range(len(probs))])
        rows = p.select("ci_month", F.col(col).cast("double").alias("x")).where("x is not null").join(F.broadcast(marks), "ci_month")  # a row per month
        share = rows.groupBy("ci_month").agg(F.count(F.lit(1)).alias("n"), *[f(F.when(c, 1.0).otherwise(0.0)).alias(f"{k}{i}") for i in range(len(probs))
                                             for k, f, c in (("lt", F.avg, F.col("x") < F.col(f"q{i}")), ("le", F.avg, F.col("x") <= F.col(f"q{i}")))])
        # the ranks of a value are a range; the wanted one lies in it, up to the error
        tests = F.array(*[F.struct(F.lit(q).alias("prob"), ((F.col(f"lt{i}") - sketch_error() <= q) & (F.col(f"le{i}") + sketch_error() >= q)).alias("within"))
                          for i, q in enumerate(probs)])
        one = share.select(F.lit(col).alias("measure"), "ci_month", "n", F.explode(tests).alias("t")).select("measure", "ci_month", "n", "t.prob", "t.within")
        out = one if out is None else out.union(one)
    return out


def q_visits_per_entity(spark, sf_dir):
    return _describe_cols(visits_per_entity(prepared(spark, sf_dir), MEMBER_COL))


def q_key_overlap(spark, sf_dir):
    return key_overlap(clean_union(spark, sf_dir), MEMBER_COL, "train_set")


def q_profile_nulls(spark, sf_dir):
    prof = profile_nulls(clean_union(spark, sf_dir), with_types=False)
    return prof.select("column_name", "rows", "nulls", round6("null_share").alias("null_share"))


FREQ_COLS = ("channel_code", "main_product_code", "member_age_buckets", "cluster_code",
             "resort_type_code")


def q_frequency_compare(spark, sf_dir):
    fc = frequency_compare(clean_union(spark, sf_dir), FREQ_COLS, "train_set")
    return fc.select("attribute", "value", "n_train", "n_test",
                     round6("share_train").alias("share_train"),
                     round6("share_test").alias("share_test"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "date_parse": q_date_parse,
    "calendar_parts": q_calendar_parts,
    "date_gaps": q_date_gaps,
    "reset_invalid_rows": q_reset_invalid_rows,
    "source_union": q_source_union,
    "impute_round": q_impute_round,
    "ratios": q_ratios,
    "ratios_as_observed": q_ratios_as_observed,
    "csv_roundtrip": q_csv_roundtrip,
    "schema_report": q_schema_report,
    "feature_projection": q_feature_projection,
    "count_back_single": q_count_back_single,
    "count_back_pair": q_count_back_pair,
    "count_back_triple": q_count_back_triple,
    "count_back_wide": q_count_back_wide,
    "stats_back_single": q_stats_back_single,
    "stats_back_calendar": q_stats_back_calendar,
    "stats_back_season": q_stats_back_season,
    "stats_back_ratio": q_stats_back_ratio,
    "stats_back_gap": q_stats_back_gap,
    "stats_back_train_only": q_stats_back_train_only,
    "stats_back_merged": q_stats_back_merged,
    "stats_back_out_of_fold": q_stats_back_out_of_fold,
    "visit_gaps": q_visit_gaps,
    "sequence_shift": q_sequence_shift,
    "sequence_shift_hot": q_sequence_shift_hot,
    "first_seen_index": q_first_seen_index,
    "fold_members": q_fold_members,
    "even_folds": q_even_folds,
    "fold_split": q_fold_split,
    "rmse_by_fold": q_rmse_by_fold,
    "average_predictions": q_average_predictions,
    "written_predictions": q_written_predictions,
    "percent_of_total": q_percent_of_total,
    "top_importance": q_top_importance,
    "describe_target": q_describe_target,
    "sketch_quantiles": q_sketch_quantiles,
    "visits_per_entity": q_visits_per_entity,
    "key_overlap": q_key_overlap,
    "profile_nulls": q_profile_nulls,
    "frequency_compare": q_frequency_compare,
}

GROUP_QUERY_SPECS = {
    "count_back_single": _single,
    "count_back_pair": [s for s in _cross if len(s.keys) == 2],
    "count_back_triple": [s for s in _cross if len(s.keys) == 3],
    "count_back_wide": M.count_specs_wide(),
    "stats_back_single": [s for s in _party if len(s.keys) == 1],
    "stats_back_calendar": [s for s in _party if len(s.keys) == 3] + M.stats_specs_repeat(),
    "stats_back_season": M.stats_specs_season(),
    "stats_back_ratio": [s for s in _derived if "ord" not in s.measure],
    "stats_back_gap": [s for s in _derived if "ord" in s.measure],
}
