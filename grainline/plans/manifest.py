"""The bookings feature manifest: which counts, statistics and shifts the
preset builds.  Generated from rules; output names come from the specs.

Key columns are the raw reservation columns plus the derived calendar
parts (``bk_*`` booking, ``ci_*`` check-in, ``co_*`` check-out; ``*_wday``
is the weekday with Monday = 0).
"""

from __future__ import annotations

from grainline.operators.group_back import CountBy, StatsBy
from grainline.operators.sequence import gap_name

ID = "reservation_id"

# Single raw columns counted one by one, in the reference's order.  Fixed values.
COUNT_SINGLE_RAW = (
    "channel_code", "main_product_code", "persontravellingid", "resort_region_code",
    "resort_type_code", "room_type_booked_code", "season_holidayed_code",
    "state_code_residence", "state_code_resort", "member_age_buckets", "booking_type_code",
    "memberid", "cluster_code", "reservationstatusid_code", "resort_id", "numberofadults",
    "numberofchildren", "roomnights", "total_pax",
)
# Calendar-part prefixes in the order the reference counts them.  Fixed values.
CAL_PREFIXES = ("ci", "co", "bk")
# Attributes crossed with calendar parts.  Fixed values.
CROSS_ATTRS = ("resort_region_code", "resort_type_code", "season_holidayed_code", "cluster_code")
# Key sets and attributes that statistics are taken by.  Fixed values.
RESORT_KEYS = ("resort_region_code", "resort_type_code", "state_code_resort", "cluster_code",
               "reservationstatusid_code", "resort_id")
MEMBER_KEYS = ("main_product_code", "persontravellingid", "state_code_residence",
               "member_age_buckets")
PARTY_KEYS = ("channel_code", "numberofadults", "numberofchildren", "roomnights", "total_pax",
              "member_age_buckets")
PARTY_MEASURES = ("numberofadults", "numberofchildren", "total_pax")
STATS_ATTRS = ("roomnights", "persontravellingid", "resort_type_code", "state_code_resort",
               "booking_type_code", "cluster_code")

# Derived per-row features used as statistics measures.
DAY_DIFFS = ("lead_days", "stay_days")
RATIOS = ("party_size", "child_per_adult", "nights_per_stay_day", "pax_per_night",
          "party_per_night", "child_per_night", "adult_per_night")

# Depths and attributes of the shifts.  Fixed values.
LAG_DEPTH_DATES = 4
LAG_DEPTH_ATTRS = 3
SHIFT_ATTRS = ("resort_type_code", "resort_region_code", "roomnights", "season_holidayed_code",
               "total_pax", "ci_month", "bk_month", "resort_id")

# Columns replaced by their first-appearance code.  Fixed values.
CODED_COLS = ("member_age_buckets", "memberid", "cluster_code", "reservationstatusid_code",
              "resort_id")


def _cal(prefix: str, part: str) -> str:
    return f"{prefix}_{part}"


def count_specs_single() -> list[CountBy]:
    """31 one-key counts: raw columns, then every calendar part."""
    specs = [CountBy((c,), ID) for c in COUNT_SINGLE_RAW]
    for prefix in CAL_PREFIXES:
        for part in ("year", "month", "week", "wday"):
            specs.append(CountBy((_cal(prefix, part),), ID))
    return specs


def _cross_calendar_sets() -> list[tuple[str, ...]]:
    """Calendar groupings crossed with CROSS_ATTRS: check-out before
    check-in, month, week, month+week, weekday, week+weekday."""
    sets = []
    for parts in (("month",), ("week",), ("month", "week")):
        for prefix in ("co", "ci"):
            sets.append(tuple(_cal(prefix, p) for p in parts))
    # reference order: mon(co,ci), week(co,ci), mon+week(co,ci), wday(co,ci), week+wday(co,ci)
    for parts in (("wday",), ("week", "wday")):
        for prefix in ("co", "ci"):
            sets.append(tuple(_cal(prefix, p) for p in parts))
    return sets


def count_specs_cross() -> list[CountBy]:
    """40 counts of a calendar grouping crossed with one attribute."""
    return [CountBy(cal + (attr,), ID) for cal in _cross_calendar_sets() for attr in CROSS_ATTRS]


def count_specs_wide() -> list[CountBy]:
    """8 counts over 4 to 8 keys."""
    specs = [CountBy(RESORT_KEYS, ID), CountBy(MEMBER_KEYS, ID)]
    for prefix in ("ci", "bk"):
        day = (_cal(prefix, "month"), _cal(prefix, "wday"))
        specs += [CountBy(day + RESORT_KEYS, ID), CountBy(day + MEMBER_KEYS, ID),
                  CountBy(day + PARTY_KEYS, ID)]
    # reference order: resort, member, ci+resort, ci+member, ci+party, bk+...
    return specs


def count_specs() -> list[CountBy]:
    return count_specs_single() + count_specs_cross() + count_specs_wide()


def stats_specs_party() -> list[StatsBy]:
    """36 statistics of party sizes by one attribute, and by check-in
    (month, weekday) + attribute."""
    specs = []
    for attr in STATS_ATTRS:
        for m in PARTY_MEASURES:
            specs.append(StatsBy((attr,), m))
            specs.append(StatsBy(("ci_month", "ci_wday", attr), m))
    return specs


def stats_specs_repeat() -> list[StatsBy]:
    """The reference computes the (weekday, month, nights) party
    statistics a second time under other names; same values, computed once
    here and aliased."""
    return [StatsBy(("ci_wday", "ci_month", "roomnights"), m) for m in PARTY_MEASURES]


def stats_specs_season() -> list[StatsBy]:
    return [StatsBy(("season_holidayed_code", "ci_wday", "ci_month", "roomnights"), m)
            for m in PARTY_MEASURES]


def stats_specs_derived() -> list[StatsBy]:
    """Statistics of day differences, ratios and visit gaps."""
    keys = ("ci_wday", "ci_month", "roomnights")
    specs = [StatsBy(keys, m) for m in DAY_DIFFS + RATIOS]
    specs += [StatsBy(keys, gap_name("checkin_ord", k)) for k in (1, 2)]
    specs += [StatsBy(("bk_wday", "bk_month", "roomnights"), gap_name("booking_ord", k))
              for k in (1, 2)]
    return specs


def stats_specs() -> list[StatsBy]:
    return (stats_specs_party() + stats_specs_repeat() + stats_specs_season()
            + stats_specs_derived())


def all_group_specs() -> list[CountBy | StatsBy]:
    return count_specs() + stats_specs()
