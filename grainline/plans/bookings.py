"""The bookings preset: reservations in, one feature row per reservation out.

Stages (each ends in a Parquet table under the shared checkpoint folder,
so lineage stays short and a lost executor only re-runs one stage):

1. ``prepare``   – narrow projections: reset invalid rows, union train and
   test, calendar parts, imputation, day differences, ratios, day
   ordinals, then first-appearance codes (small aggregates + joins).
2. ``sequences`` – visit gaps and attribute shifts per member: three
   orderings over one shuffle on the member (rows of hot members go by
   ranges, see ``sequence_shift``).
3. ``group``     – 134 group-back specs fused into 87 aggregates, joined
   back by broadcast (size-checked) or by a narrow shuffle join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainline.functions.dates import calendar_parts, day_ordinal, days_between
from grainline.functions.numeric import ratio
from grainline.operators.cleaning import (
    SOURCE_COL, impute, reset_rows, round_columns, tag_source)
from grainline.operators.coding import first_seen_index
from grainline.operators.group_back import group_back
from grainline.operators.sequence import (
    DEFAULT_HOT_GROUP_ROWS, Order, hot_groups, place_groups, sequence_shift, visit_gaps)
from grainline.plans import manifest as M
from grainline.session import materialize
from grainline.sources.bookings import ID_COL, MEMBER_COL, TARGET_COL

# Imputation constants of the reference.  Fixed values.
IMPUTE = {"season_holidayed_code": 5.0, "state_code_residence": 39.0}

# Input position: train rows before test rows, then by id.
POSITION = (Order(SOURCE_COL, ascending=False), Order(ID_COL))
ORD_CHECKIN = (Order("checkin_ord"),) + POSITION
ORD_BOOKING = (Order("booking_ord"), Order("checkin_ord")) + POSITION
ORD_ATTRS = (Order("checkin_ord"), Order("booking_ord")) + POSITION

# Columns never used as model features.
NON_FEATURES = (ID_COL, "booking_date", "checkin_date", "checkout_date", TARGET_COL,
                SOURCE_COL, "checkin_ord", "booking_ord", MEMBER_COL)


@dataclass(frozen=True)
class BookingsConfig:
    reset_mode: str = "zero_row"       # or "drop"
    as_observed: bool = False          # reproduce the overwritten ratio (quirk)
    hot_group_rows: int | None = None  # members with more rows go by ranges (None: default)
    broadcast_max_rows: int | None = None
    parallelism: int = 8


def clean_tagged(rows: DataFrame, cfg: BookingsConfig = BookingsConfig()) -> DataFrame:
    """Reset rows with negative nights; ``rows`` hold train and test, told
    apart by the source flag (the target is NULL on test rows)."""
    out = reset_rows(rows, F.col("roomnights") < 0, cfg.reset_mode, keep=[ID_COL, SOURCE_COL])
    return out.withColumn(TARGET_COL, F.when(F.col(SOURCE_COL) == 1, F.col(TARGET_COL)))


def clean(train: DataFrame, test: DataFrame, cfg: BookingsConfig = BookingsConfig()) -> DataFrame:
    """Union, tag, reset rows with negative nights."""
    return clean_tagged(tag_source(train, test), cfg)


def row_features(df: DataFrame, cfg: BookingsConfig = BookingsConfig()) -> DataFrame:
    """All per-row derived columns (one projection)."""
    cal = {}
    for col, prefix in (("booking_date", "bk"), ("checkin_date", "ci"), ("checkout_date", "co")):
        cal.update(calendar_parts(col, prefix))
    out = df.withColumns(cal)
    out = impute(out, IMPUTE)
    out = round_columns(out, list(IMPUTE), 0)
    party = F.col("numberofadults") + F.col("numberofchildren")
    out = out.withColumns({
        "lead_days": days_between("checkin_date", "booking_date"),
        "stay_days": days_between("checkout_date", "checkin_date"),
        "party_size": party,
    })
    out = out.withColumns({
        "child_per_adult": ratio("numberofchildren", "numberofadults"),
        "nights_per_stay_day": ratio("roomnights", "stay_days"),
        "pax_per_night": ratio("total_pax", "roomnights"),
        "party_per_night": ratio("total_pax" if cfg.as_observed else "party_size", "roomnights"),
        "child_per_night": ratio("numberofchildren", "roomnights"),
        "adult_per_night": ratio("numberofadults", "roomnights"),
        "checkin_ord": day_ordinal("checkin_date"),
        "booking_ord": day_ordinal("booking_date"),
    })
    return out


def prepare(train: DataFrame, test: DataFrame, cfg: BookingsConfig = BookingsConfig(),
            write: bool = True) -> DataFrame:
    return prepare_tagged(tag_source(train, test), cfg, write)


def prepare_tagged(rows: DataFrame, cfg: BookingsConfig = BookingsConfig(), write: bool = True) -> DataFrame:
    out = row_features(clean_tagged(rows, cfg), cfg)
    if write:
        # every code table scans these rows: compute the fixture joins once
        out = materialize(out, "rows")
    out = first_seen_index(out, M.CODED_COLS, POSITION)
    return materialize(out, "prepared") if write else out


def sequences(df: DataFrame, cfg: BookingsConfig = BookingsConfig(), write: bool = True) -> DataFrame:
    # the hot members are the same for all orderings
    limit = DEFAULT_HOT_GROUP_ROWS if cfg.hot_group_rows is None else cfg.hot_group_rows
    kw = {"hot": hot_groups(df, MEMBER_COL, limit)}
    if not kw["hot"].head(1):
        df = place_groups(df, MEMBER_COL)  # one shuffle for all orderings
    out = visit_gaps(df, MEMBER_COL, "checkin_ord", M.LAG_DEPTH_DATES, ORD_CHECKIN, **kw)
    out = visit_gaps(out, MEMBER_COL, "booking_ord", M.LAG_DEPTH_DATES, ORD_BOOKING, **kw)
    offsets = list(range(1, M.LAG_DEPTH_ATTRS + 1)) + [-k for k in range(1, M.LAG_DEPTH_ATTRS + 1)]
    out = sequence_shift(out, MEMBER_COL, list(M.SHIFT_ATTRS), offsets, ORD_ATTRS, **kw)
    return materialize(out, "sequences") if write else out


def group_features(df: DataFrame, cfg: BookingsConfig = BookingsConfig(), specs=None) -> DataFrame:
    kw = {} if cfg.broadcast_max_rows is None else {"broadcast_max_rows": cfg.broadcast_max_rows}
    return group_back(df, specs or M.all_group_specs(), ID_COL, parallelism=cfg.parallelism, **kw)


def build_features(train: DataFrame, test: DataFrame,
                   cfg: BookingsConfig = BookingsConfig()) -> DataFrame:
    """The full feature table (one row per reservation)."""
    return build_features_tagged(tag_source(train, test), cfg)


def build_features_tagged(rows: DataFrame, cfg: BookingsConfig = BookingsConfig()) -> DataFrame:
    """The same from train and test rows in one table with the source flag."""
    return group_features(sequences(prepare_tagged(rows, cfg), cfg), cfg)


def feature_columns(df: DataFrame, exclude=NON_FEATURES) -> list[str]:
    """Model features: every column except ids, dates, target and flags."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]
