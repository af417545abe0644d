"""DuckDB SQL for the correctness gate.

Each query re-derives the reservations from the test tables with the same
fixed mapping as ``grainline.sources.tables`` and then computes the
feature in plain SQL (GROUP BY + LEFT JOIN, window LAG/LEAD, ...), written
independently of the Spark code path.  Floating statistics are rounded to
6 decimals on both sides (snapped to 9 decimals, then ``rint(x * 1e6) /
1e6`` in Spark and ``round_even`` here) because summation order differs.
"""

from __future__ import annotations

from grainline.operators.group_back import CountBy, StatsBy
from grainline.operators.sequence import gap_name, shift_name
from grainline.plans import manifest as M

RAW_CTE = """
li AS (
  SELECT l_orderkey,
         count(*) AS n_lines,
         min(CAST(l_shipdate AS DATE)) AS first_ship,
         max(CAST(l_shipdate AS DATE)) AS last_ship,
         sum(l_quantity) AS qty,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         min(l_suppkey) AS supp
  FROM lineitem GROUP BY l_orderkey
),
raw AS (
  SELECT o.o_orderkey AS reservation_id,
         CAST(o.o_orderdate AS DATE) AS booking_date,
         li.first_ship AS checkin_date,
         CAST(li.last_ship + INTERVAL 1 DAY AS DATE) AS checkout_date,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS channel_code,
         CAST(c.c_nationkey % 7 + 1 AS INTEGER) AS main_product_code,
         CAST(ceil(li.qty / li.n_lines / 10.0) AS INTEGER) AS numberofadults,
         CAST(li.n_ret AS INTEGER) AS numberofchildren,
         CAST(45 + CAST(li.qty AS BIGINT) % 4 AS INTEGER) AS persontravellingid,
         CAST(li.supp % 3 + 1 AS INTEGER) AS resort_region_code,
         CAST(li.supp % 7 AS INTEGER) AS resort_type_code,
         CAST(least(li.n_lines, 6) AS INTEGER) AS room_type_booked_code,
         CAST(li.n_lines - 2 AS INTEGER) AS roomnights,
         CASE WHEN o.o_orderstatus = 'P' THEN NULL
              ELSE CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE)
                   + CASE WHEN li.n_ret % 2 = 1 THEN 0.5 ELSE 0.0 END END AS season_holidayed_code,
         CASE WHEN c.c_acctbal < 0 THEN NULL ELSE CAST(c.c_nationkey AS DOUBLE) END
           AS state_code_residence,
         CAST(li.supp % 11 + 1 AS INTEGER) AS state_code_resort,
         CAST(ceil(li.qty / li.n_lines / 10.0) AS INTEGER) + CAST(li.n_ret AS INTEGER) AS total_pax,
         c.c_mktsegment AS member_age_buckets,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 2 END AS booking_type_code,
         o.o_custkey AS memberid,
         'C' || CAST(n.n_regionkey AS VARCHAR) AS cluster_code,
         o.o_orderstatus AS reservationstatusid_code,
         'R' || CAST(li.supp AS VARCHAR) AS resort_id,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN NULL
              ELSE coalesce(li.qty, 0.0) / 20.0 + o.o_totalprice / 500000.0 END
           AS amount_spent_per_room_night_scaled,
         c.c_mktsegment = 'HOUSEHOLD' AS is_test
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
)"""

# zero of each raw column for the "reset invalid rows" step
_ZERO = {
    "booking_date": "DATE '1970-01-01'", "checkin_date": "DATE '1970-01-01'",
    "checkout_date": "DATE '1970-01-01'",
    "season_holidayed_code": "0.0", "state_code_residence": "0.0",
    "amount_spent_per_room_night_scaled": "0.0",
    "member_age_buckets": "'0'", "cluster_code": "'0'", "reservationstatusid_code": "'0'",
    "resort_id": "'0'", "memberid": "CAST(0 AS BIGINT)",
}
_RAW_COLS = ["reservation_id", "booking_date", "checkin_date", "checkout_date", "channel_code",
             "main_product_code", "numberofadults", "numberofchildren", "persontravellingid",
             "resort_region_code", "resort_type_code", "room_type_booked_code", "roomnights",
             "season_holidayed_code", "state_code_residence", "state_code_resort", "total_pax",
             "member_age_buckets", "booking_type_code", "memberid", "cluster_code",
             "reservationstatusid_code", "resort_id", "amount_spent_per_room_night_scaled"]


def _reset_select(cols):
    out = []
    for c in cols:
        if c == "reservation_id":
            out.append(c)
        else:
            z = _ZERO.get(c, "0")
            out.append(f"CASE WHEN coalesce(roomnights < 0, false) THEN {z} ELSE {c} END AS {c}")
    return ",\n         ".join(out)


CLEAN_CTE = RAW_CTE + f""",
tr AS (
  SELECT {_reset_select(_RAW_COLS)}
  FROM raw WHERE NOT is_test
),
te AS (
  SELECT {_reset_select([c for c in _RAW_COLS if c != 'amount_spent_per_room_night_scaled'])}
  FROM raw WHERE is_test
),
u AS (
  SELECT *, 1 AS train_set FROM tr
  UNION ALL BY NAME
  SELECT *, 0 AS train_set FROM te
)"""


def _cal_sql(col: str, prefix: str) -> str:
    return (f"CAST(year({col}) AS INTEGER) AS {prefix}_year, "
            f"CAST(month({col}) AS INTEGER) AS {prefix}_month, "
            f"CAST(weekofyear({col}) AS INTEGER) AS {prefix}_week, "
            f"CAST(isodow({col}) - 1 AS INTEGER) AS {prefix}_wday")


def _ratio_sql(a: str, b: str) -> str:
    return (f"round_even(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0.0) * 100.0, 0) / 100.0")


FEAT_CTE = CLEAN_CTE + f""",
f1 AS (
  SELECT * REPLACE (
           round_even(coalesce(season_holidayed_code, 5.0), 0) AS season_holidayed_code,
           round_even(coalesce(state_code_residence, 39.0), 0) AS state_code_residence),
         {_cal_sql('booking_date', 'bk')},
         {_cal_sql('checkin_date', 'ci')},
         {_cal_sql('checkout_date', 'co')},
         CAST(date_diff('day', booking_date, checkin_date) AS INTEGER) AS lead_days,
         CAST(date_diff('day', checkin_date, checkout_date) AS INTEGER) AS stay_days,
         numberofadults + numberofchildren AS party_size,
         {_ratio_sql('numberofchildren', 'numberofadults')} AS child_per_adult,
         {_ratio_sql('roomnights', "CAST(date_diff('day', checkin_date, checkout_date) AS INTEGER)")}
           AS nights_per_stay_day,
         {_ratio_sql('total_pax', 'roomnights')} AS pax_per_night,
         {_ratio_sql('numberofadults + numberofchildren', 'roomnights')} AS party_per_night,
         {_ratio_sql('numberofchildren', 'roomnights')} AS child_per_night,
         {_ratio_sql('numberofadults', 'roomnights')} AS adult_per_night,
         CAST(date_diff('day', DATE '0001-01-01', checkin_date) + 1 AS INTEGER) AS checkin_ord,
         CAST(date_diff('day', DATE '0001-01-01', booking_date) + 1 AS INTEGER) AS booking_ord,
         row_number() OVER (ORDER BY train_set DESC, reservation_id) AS _pos
  FROM u
)"""


def _codes_cte() -> str:
    parts = []
    for c in M.CODED_COLS:
        parts.append(f"""code_{c} AS (
  SELECT {c} AS _v, row_number() OVER (ORDER BY min(_pos)) - 1 AS _code
  FROM f1 WHERE {c} IS NOT NULL GROUP BY {c}
)""")
    joins = "\n  ".join(f"LEFT JOIN code_{c} ON f1.{c} = code_{c}._v" for c in M.CODED_COLS)
    repl = ", ".join(f"coalesce(code_{c}._code, -1) AS {c}" for c in M.CODED_COLS)
    return ",\n".join(parts) + f""",
prep AS (
  SELECT f1.* EXCLUDE (_pos) REPLACE ({repl})
  FROM f1
  {joins}
)"""


PREP_CTE = FEAT_CTE + ",\n" + _codes_cte()

_ORD1 = "checkin_ord ASC NULLS LAST, train_set DESC NULLS LAST, reservation_id ASC NULLS LAST"
_ORD2 = ("booking_ord ASC NULLS LAST, checkin_ord ASC NULLS LAST, train_set DESC NULLS LAST, "
         "reservation_id ASC NULLS LAST")
_ORD3 = ("checkin_ord ASC NULLS LAST, booking_ord ASC NULLS LAST, train_set DESC NULLS LAST, "
         "reservation_id ASC NULLS LAST")


def _shift_sql(col: str, k: int, win: str) -> str:
    fn = f"lag({col}, {k})" if k > 0 else f"lead({col}, {-k})"
    return f"{fn} OVER {win} AS {shift_name(col, k)}"


def _seq_selects() -> list[str]:
    sel = []
    date_offsets = list(range(1, M.LAG_DEPTH_DATES + 1)) + [-k for k in range(1, M.LAG_DEPTH_DATES + 1)]
    for col, win in (("checkin_ord", "w1"), ("booking_ord", "w2")):
        sel += [_shift_sql(col, k, win) for k in date_offsets]
    attr_offsets = list(range(1, M.LAG_DEPTH_ATTRS + 1)) + [-k for k in range(1, M.LAG_DEPTH_ATTRS + 1)]
    for col in M.SHIFT_ATTRS:
        sel += [_shift_sql(col, k, "w3") for k in attr_offsets]
    return sel


def _gap_selects() -> list[str]:
    sel = []
    offs = list(range(1, M.LAG_DEPTH_DATES + 1)) + [-k for k in range(1, M.LAG_DEPTH_DATES + 1)]
    for col in ("checkin_ord", "booking_ord"):
        sel += [f"{col} - {shift_name(col, k)} AS {gap_name(col, k)}" for k in offs]
    return sel


SEQ_CTE = PREP_CTE + f""",
seq0 AS (
  SELECT *,
         {(','+chr(10)+'         ').join(_seq_selects())}
  FROM prep
  WINDOW w1 AS (PARTITION BY memberid ORDER BY {_ORD1}),
         w2 AS (PARTITION BY memberid ORDER BY {_ORD2}),
         w3 AS (PARTITION BY memberid ORDER BY {_ORD3})
),
seq AS (
  SELECT *, {(','+chr(10)+'         ').join(_gap_selects())}
  FROM seq0
)"""


def with_cte(cte: str, body: str) -> str:
    return "WITH " + cte.strip() + "\n" + body


def round6(expr: str) -> str:
    """Same two-step rounding as the Spark side (snap to 9 decimals first)."""
    snapped = f"(round_even(({expr}) * 1000000000.0, 0) / 1000000000.0)"
    return f"round_even({snapped} * 1000000.0, 0) / 1000000.0"


_SQL_AGG = {"count": "count({m})", "min": "min({m})", "max": "max({m})",
            "mean": "avg({m})", "std": "stddev_samp({m})"}
_ROUNDED = {"mean", "std"}


def group_back_sql(specs, base: str = "seq", cte: str = SEQ_CTE, fit: str | None = None) -> str:
    """id + every spec output: one GROUP BY per spec (over the rows of ``fit``),
    LEFT JOINed on keys.  A column ``other`` of ``base`` beside a column ``fold``
    of ``fit``: rows of fold ``other`` are left out of the row's groups."""
    split = fit is not None and fit.endswith("folded")
    fit = fit or base
    joins, cols = [], []
    for i, s in enumerate(specs):
        keys = list(s.keys)
        not_null = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        aggs = []
        for name, (stat, m) in s.outputs():
            a = _SQL_AGG[stat].format(m=m)
            aggs.append(f"{a} AS {name}")
            cols.append(round6(f"g{i}.{name}") + f" AS {name}" if stat in _ROUNDED
                        else f"g{i}.{name}")
        on = " AND ".join(f"b.{k} = g{i}.{k}" for k in keys)
        if split:
            each = f"(SELECT DISTINCT {', '.join(keys)}, other FROM {base})"
            match = " AND ".join(f"f.{k} = o.{k}" for k in keys)
            keyed = ", ".join(f"o.{k}" for k in keys)
            joins.append(f"LEFT JOIN (SELECT {keyed}, o.other, {', '.join(a.replace('(', '(f.', 1) for a in aggs)} FROM {each} o JOIN {fit} f "
                         f"ON {match} AND f.fold <> o.other GROUP BY ALL) g{i} ON {on} AND b.other = g{i}.other")
        else:
            joins.append(f"LEFT JOIN (SELECT {', '.join(keys)}, {', '.join(aggs)} FROM {fit} "
                         f"WHERE {not_null} GROUP BY {', '.join(keys)}) g{i} ON {on}")
    body = (f"SELECT b.reservation_id, {', '.join(cols)}\nFROM {base} b\n" + "\n".join(joins))
    return with_cte(cte, body)


__all__ = ["RAW_CTE", "CLEAN_CTE", "FEAT_CTE", "PREP_CTE", "SEQ_CTE", "with_cte", "round6",
           "group_back_sql", "CountBy", "StatsBy"]


# ---- per-query oracle SQL ------------------------------------------------------

def _cols(*names: str) -> str:
    return ", ".join(names)


def _date_parse() -> str:
    return """
SELECT o_orderkey AS reservation_id,
       CAST(o_orderdate AS DATE) AS booked_on,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS alt_on
FROM orders"""


def _calendar_parts() -> str:
    cols = [f"{p}_{x}" for p in ("bk", "ci", "co") for x in ("year", "month", "week", "wday")]
    return with_cte(FEAT_CTE, f"SELECT reservation_id, {_cols(*cols)} FROM f1")


def _date_gaps() -> str:
    return with_cte(FEAT_CTE, "SELECT reservation_id, lead_days, stay_days, checkin_ord, "
                              "booking_ord FROM f1")


def _reset_invalid_rows() -> str:
    return with_cte(CLEAN_CTE, f"SELECT {_cols(*_RAW_COLS)} FROM u")


def _source_union() -> str:
    return with_cte(CLEAN_CTE, """
SELECT reservation_id, CASE WHEN train_set = 1 THEN 'train' ELSE 'test' END AS part,
       amount_spent_per_room_night_scaled
FROM u""")


def _impute_round() -> str:
    return with_cte(FEAT_CTE, "SELECT reservation_id, season_holidayed_code, "
                              "state_code_residence FROM f1")


def _ratios() -> str:
    return with_cte(FEAT_CTE, f"SELECT reservation_id, {_cols(*M.RATIOS)} FROM f1")


def _ratios_as_observed() -> str:
    return with_cte(FEAT_CTE, "SELECT reservation_id, pax_per_night, pax_per_night AS party_per_night FROM f1")


def _csv_roundtrip() -> str:
    return with_cte(RAW_CTE, f"SELECT {_cols(*_RAW_COLS)} FROM raw")


#: Types of the cleaned rows, by name (fixed values: the fixture's types).
_KINDS = {"reservation_id": "bigint", "memberid": "bigint", "booking_date": "date", "checkin_date": "date", "checkout_date": "date",
          "season_holidayed_code": "double", "state_code_residence": "double", "amount_spent_per_room_night_scaled": "double",
          "member_age_buckets": "string", "cluster_code": "string", "reservationstatusid_code": "string", "resort_id": "string"}


def _schema_report() -> str:
    parts = [f"SELECT '{c}' AS column, '{_KINDS.get(c, 'int')}' AS dtype, {i} AS position, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM u"
             for i, c in enumerate(_RAW_COLS + ["train_set"])]
    return with_cte(CLEAN_CTE, " UNION ALL ".join(parts))


def _feature_projection() -> str:
    from grainline.plans.bookings import NON_FEATURES
    cal = [f"{p}_{x}" for p in ("bk", "ci", "co") for x in ("year", "month", "week", "wday")]
    cols = [c for c in dict.fromkeys([*_RAW_COLS, "train_set", *cal, "lead_days", "stay_days", "party_size", *M.RATIOS]) if c not in NON_FEATURES]
    parts = [f"SELECT '{c}' AS column_name, count(*) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM prep" for c in cols]
    return with_cte(PREP_CTE, " UNION ALL ".join(parts))


def _sequence_shift_hot() -> str:
    sel = [_shift_sql(c, k, "w") for c in ("l_extendedprice", "l_suppkey") for k in (1, 2, -1)]
    return f"""SELECT l_orderkey, l_linenumber, {_cols(*sel)} FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate NULLS LAST, l_orderkey NULLS LAST, l_linenumber NULLS LAST,
             l_extendedprice NULLS LAST, l_suppkey NULLS LAST)"""


_MATRIX_COLS = ("checkin_ord", "child_per_adult", "pax_per_night")
_STUMP_COLS = ("channel_code", "main_product_code", "resort_region_code", "room_type_booked_code")


def _assemble_matrix() -> str:
    cols = [f"{round6(f'coalesce(CAST({c} AS DOUBLE), -999.0)')} AS x_{c}" for c in _MATRIX_COLS + _STUMP_COLS]
    return with_cte(PREP_CTE, f"SELECT reservation_id, {_cols(*cols)} FROM prep")


def _stump_split() -> str:
    """Every midpoint of every column, by the summed squared error left."""
    x = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), -999.0) AS v, "
                           "amount_spent_per_room_night_scaled AS y FROM prep WHERE train_set = 1" for i, c in enumerate(_STUMP_COLS))
    return with_cte(PREP_CTE + f""",
x AS ({x}),
d AS (SELECT DISTINCT i, feature, v FROM x),
t AS (SELECT i, feature, (v + lead(v) OVER (PARTITION BY i ORDER BY v)) / 2 AS threshold FROM d),
s AS (SELECT t.i, t.feature, threshold, avg(y) FILTER (WHERE v <= threshold) AS l, avg(y) FILTER (WHERE v > threshold) AS r,
             var_pop(y) FILTER (WHERE v <= threshold) * count(*) FILTER (WHERE v <= threshold)
             + var_pop(y) FILTER (WHERE v > threshold) * count(*) FILTER (WHERE v > threshold) AS err
      FROM t JOIN x ON t.i = x.i WHERE threshold IS NOT NULL GROUP BY ALL)""", f"""
SELECT feature, threshold, {round6('l')} AS mean_left, {round6('r')} AS mean_right FROM s ORDER BY err, i, threshold LIMIT 1""")


#: The learner of the ``*_values`` queries (fixed values: its columns, depth,
#: step, smallest leaf, budgets and patience).
_TREE_COLS = ("room_type_booked_code", "bk_wday", "bk_month", "state_code_residence")
_DEPTH, _STEP, _LEAF, _BUDGETS, _PATIENCE = 2, 0.8, 150, (2, 4), 1


def _trees_cte() -> str:
    """Boosted trees in SQL, all folds side by side: run g < 10 learns from
    the rows of other folds, run 10 from all train rows.  After round r column
    ``f{r}`` is the prediction; ``splits`` has every split with its gain."""
    cols = ", ".join(f"x{i}" for i in range(len(_TREE_COLS)))
    known = ", ".join(f"coalesce(CAST({c} AS DOUBLE), -999.0) AS x{i}" for i, c in enumerate(_TREE_COLS))
    y = "amount_spent_per_room_night_scaled"
    out = f"""
base AS MATERIALIZED (SELECT reservation_id AS id, fold, {y} AS y, {known} FROM tf
  UNION ALL SELECT reservation_id, -1, NULL, {known} FROM prep WHERE train_set = 0),
r0 AS MATERIALIZED (SELECT g, id, fold, fold >= 0 AND fold <> g AS dev, y, y AS t, 0.0 AS f0, {cols} FROM base, range(11) AS r(g))"""
    splits, kept = [], "f0"
    for r in range(1, _BUDGETS[-1] + 1):
        at = f"n{r}_0"
        out += f""",
{at} AS MATERIALIZED (SELECT *, 1 AS node, true AS open FROM r{r - 1})"""
        for d in range(1, _DEPTH + 1):
            k = f"{r}_{d}"
            long = " UNION ALL ".join(f"SELECT g, node, t, {i} AS i, x{i} AS v FROM {at} WHERE dev AND open" for i in range(len(_TREE_COLS)))
            side = "PARTITION BY g, node, i"
            pick = "CASE b.i " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(_TREE_COLS))) + " END"
            out += f""",
v{k} AS MATERIALIZED (SELECT g, node, i, v, count(*) AS n, sum(t) AS s, sum(t * t) AS q FROM ({long}) GROUP BY ALL),
c{k} AS MATERIALIZED (SELECT g, node, i, (v + lead(v) OVER ({side} ORDER BY v)) / 2 AS threshold,
  sum(n) OVER ({side} ORDER BY v) AS nl, sum(s) OVER ({side} ORDER BY v) AS sl, sum(q) OVER ({side} ORDER BY v) AS ql,
  sum(n) OVER ({side}) AS n, sum(s) OVER ({side}) AS s, sum(q) OVER ({side}) AS q FROM v{k}),
g{k} AS MATERIALIZED (SELECT g, node, i, threshold, (q / n - (s / n) ** 2) - nl / n * (ql / nl - (sl / nl) ** 2)
  - (n - nl) / n * ((q - ql) / (n - nl) - ((s - sl) / (n - nl)) ** 2) AS gain
  FROM c{k} WHERE threshold IS NOT NULL AND nl >= {_LEAF} AND n - nl >= {_LEAF}),
b{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, node ORDER BY gain DESC, i, threshold) AS place FROM g{k} WHERE gain > 1e-12)
  WHERE place = 1),
n{k} AS MATERIALIZED (SELECT a.* REPLACE (b.node IS NOT NULL AS open,
  CASE WHEN b.node IS NULL THEN a.node WHEN {pick} <= b.threshold THEN 2 * a.node ELSE 2 * a.node + 1 END AS node)
  FROM {at} a LEFT JOIN b{k} b ON a.g = b.g AND a.node = b.node)"""
            splits.append(f"SELECT g, {r} AS r, i, gain FROM b{k}")
            at = f"n{k}"
        weight = 1.0 if r == 1 else _STEP
        out += f""",
l{r} AS MATERIALIZED (SELECT g, node, avg(t) AS p FROM {at} WHERE dev GROUP BY g, node),
r{r} AS MATERIALIZED (SELECT a.g, id, fold, dev, y, 2 * (y - (f{r - 1} + {weight} * p)) AS t, {kept}, f{r - 1} + {weight} * p AS f{r}, {cols}
  FROM {at} a JOIN l{r} USING (g, node))"""
        kept += f", f{r}"
    last = f"r{_BUDGETS[-1]}"
    errors = " UNION ALL ".join(f"SELECT g, {r} AS r, sqrt(avg((y - f{r}) * (y - f{r}))) AS rmse FROM {last} WHERE fold = g GROUP BY g" for r in range(1, _BUDGETS[-1] + 1))
    first = f"(SELECT g, arg_min(r, rmse) AS r FROM curve WHERE r <= {_BUDGETS[0]} GROUP BY g)"
    whole = "(SELECT g, arg_min(r, rmse) AS r FROM curve GROUP BY g)"
    held = "CASE k.best " + " ".join(f"WHEN {r} THEN f{r}" for r in range(1, _BUDGETS[-1] + 1)) + " END"
    return FOLDS_CTE + "," + out + f""",
splits AS MATERIALIZED ({" UNION ALL ".join(splits)}),
curve AS MATERIALIZED ({errors}),
kept AS MATERIALIZED (SELECT a.g, CASE WHEN a.r + {_PATIENCE} <= {_BUDGETS[0]} THEN a.r ELSE z.r END AS best,
  CASE WHEN a.r + {_PATIENCE} <= {_BUDGETS[0]} THEN {_BUDGETS[0]} ELSE {_BUDGETS[1]} END AS fitted FROM {first} a JOIN {whole} z USING (g)),
oof AS MATERIALIZED (SELECT id, fold, {held} AS p FROM {last} a JOIN kept k ON a.g = k.g WHERE fold = a.g),
refit AS MATERIALIZED (SELECT id, {held} AS p FROM {last} a, kept k WHERE a.g = 10 AND a.fold = -1),
imp AS MATERIALIZED (
  SELECT k.g AS fold, stage, f.i, count(s.i) AS split, coalesce(sum(gain), 0.0) AS gain_sum
  FROM kept k CROSS JOIN (SELECT unnest(['dev', 'refit']) AS stage) CROSS JOIN (SELECT unnest(range({len(_TREE_COLS)})) AS i) f
  LEFT JOIN splits s ON s.i = f.i AND s.r <= k.best AND s.g = CASE stage WHEN 'dev' THEN k.g ELSE 10 END GROUP BY k.g, stage, f.i),
names AS (SELECT unnest(range({len(_TREE_COLS)})) AS i, unnest([{', '.join(repr(c) for c in _TREE_COLS)}]) AS feature)"""


def _oof_values() -> str:
    return with_cte(_trees_cte(), f"SELECT id AS reservation_id, CAST(fold AS INTEGER) AS fold, {round6('p')} AS prediction FROM oof")


def _refit_values() -> str:
    return with_cte(_trees_cte(), f"SELECT id AS reservation_id, {round6('avg(p)')} AS prediction, count(p) AS n_models FROM refit GROUP BY id")


def _importance_values() -> str:
    gain = "gain_sum * 100.0 / nullif(sum(gain_sum) OVER (PARTITION BY fold, stage), 0)"
    return with_cte(_trees_cte(), f"""SELECT CAST(fold AS INTEGER) AS fold, stage, feature, split, {round6('gain_sum')} AS gain_sum, {round6(gain)} AS gain
FROM imp JOIN names USING (i)""")


def _cv_rounds_values() -> str:
    return with_cte(_trees_cte(), f"""SELECT CAST(k.g AS INTEGER) AS fold, CAST(best AS INTEGER) AS best_rounds, CAST(fitted AS INTEGER) AS fitted_rounds,
  {round6('c.rmse')} AS rmse, {round6('z.rmse')} AS last_rmse
FROM kept k JOIN curve c ON c.g = k.g AND c.r = best JOIN curve z ON z.g = k.g AND z.r = fitted""")


def _written_importance() -> str:
    return with_cte(_trees_cte(), f"""SELECT feature, CAST(split AS BIGINT) AS split, {round6('gain_sum')} AS gain_sum, {round6('gain_sum * 100.0 / total')} AS gain
FROM (SELECT feature, sum(split) AS split, sum(gain_sum) AS gain_sum, sum(sum(gain_sum)) OVER () AS total FROM imp JOIN names USING (i) WHERE stage = 'refit' GROUP BY feature)
ORDER BY gain_sum DESC, feature LIMIT 25""")


def _oof_coverage() -> str:
    return with_cte(FOLDS_CTE, f"""SELECT reservation_id, fold, {round6('amount_spent_per_room_night_scaled')} AS label,
       CAST(1 AS BIGINT) AS n_predictions FROM tf WHERE fold IS NOT NULL""")


def _refit_coverage() -> str:
    return with_cte(FOLDS_CTE, """SELECT reservation_id, (SELECT count(DISTINCT fold) FROM tf) AS n_models, true AS predicted
FROM prep WHERE train_set = 0""")


def _visit_gaps() -> str:
    offs = list(range(1, 5)) + [-k for k in range(1, 5)]
    cols = [shift_name(c, k) for c in ("checkin_ord", "booking_ord") for k in offs]
    cols += [gap_name(c, k) for c in ("checkin_ord", "booking_ord") for k in offs]
    return with_cte(SEQ_CTE, f"SELECT reservation_id, {_cols(*cols)} FROM seq")


def _sequence_shift() -> str:
    offs = list(range(1, 4)) + [-k for k in range(1, 4)]
    cols = [shift_name(c, k) for c in M.SHIFT_ATTRS for k in offs]
    return with_cte(SEQ_CTE, f"SELECT reservation_id, {_cols(*cols)} FROM seq")


def _first_seen_index() -> str:
    return with_cte(PREP_CTE, f"SELECT reservation_id, {_cols(*M.CODED_COLS)} FROM prep")


def _fold_expr(col: str, k: int = 10, seed: int = 2017) -> str:
    return (f"CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8))::BIGINT "
            f"% {k} AS INTEGER)")


FOLDS_CTE = PREP_CTE + f""",
tf AS (
  SELECT *, {_fold_expr('memberid')} AS fold FROM prep WHERE train_set = 1
),
per AS (
  SELECT fold, roomnights, sum(amount_spent_per_room_night_scaled) AS fold_sum,
         count(amount_spent_per_room_night_scaled) AS fold_n
  FROM tf GROUP BY fold, roomnights
),
tot AS (
  SELECT roomnights, sum(amount_spent_per_room_night_scaled) AS all_sum,
         count(amount_spent_per_room_night_scaled) AS all_n
  FROM tf GROUP BY roomnights
)"""

DEV_MEANS = """
means AS (
  SELECT f.fold, (SELECT sum(all_sum) FROM tot) AS ts, (SELECT sum(all_n) FROM tot) AS tn,
         coalesce(sum(per.fold_sum), 0.0) AS fs, coalesce(sum(per.fold_n), 0) AS fn
  FROM (SELECT unnest(range(10)) AS fold) f LEFT JOIN per ON per.fold = f.fold GROUP BY f.fold
),
dm AS (SELECT fold, (ts - fs) / nullif(CAST(tn - fn AS DOUBLE), 0.0) AS dev_mean FROM means)"""

_STANDIN = ("(tot.all_sum - coalesce(per.fold_sum, 0.0)) / "
            "nullif(CAST(tot.all_n - coalesce(per.fold_n, 0) AS DOUBLE), 0.0)")


def _fold_members() -> str:
    return with_cte(FOLDS_CTE, "SELECT DISTINCT memberid, fold FROM tf")


def _even_folds() -> str:
    return with_cte(PREP_CTE, """SELECT memberid, fold, count(*) OVER (PARTITION BY fold) AS fold_members
FROM (SELECT memberid, CAST((row_number() OVER (ORDER BY md5('2017:' || CAST(memberid AS VARCHAR)), memberid) - 1) % 10 AS INTEGER) AS fold
      FROM (SELECT DISTINCT memberid FROM prep WHERE train_set = 1 AND memberid IS NOT NULL))""")


def _fitted(specs) -> dict[str, str]:
    """Train rows describe all rows; then: other folds describe a row.  A group
    without any value of a measure has no count there."""
    trained = PREP_CTE + ",\ntrained AS (SELECT * FROM prep WHERE train_set = 1)"
    folds = FOLDS_CTE + """,
folded AS (SELECT * FROM tf WHERE fold IS NOT NULL),
asked AS (SELECT prep.*, coalesce(folded.fold, -1) AS other FROM prep LEFT JOIN folded USING (reservation_id))"""
    train_only = group_back_sql(specs, "prep", trained, "trained")
    return {"stats_back_train_only": train_only, "stats_back_merged": train_only,
            "stats_back_out_of_fold": group_back_sql([s for s in specs if s.keys != ("memberid",)], "asked", folds, "folded")}


def _sketch_quantiles() -> str:
    parts = [f"SELECT '{c}' AS measure, ci_month, count({c}) AS n FROM prep WHERE train_set = 1 AND ci_month IS NOT NULL AND {c} IS NOT NULL GROUP BY ci_month"
             for c in ("amount_spent_per_room_night_scaled", "total_pax")]
    return with_cte(PREP_CTE, f"""SELECT measure, ci_month, n, prob, true AS within FROM ({' UNION ALL '.join(parts)}),
  (SELECT CAST(unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS DOUBLE) AS prob)""")


def _assemble_missing() -> str:
    fill = lambda c: f"coalesce({c}, (SELECT min({c}) - greatest(1.0, abs(min({c})) * 1e-6) FROM r))"
    return f"""WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_acctbal * 10 END AS balance, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS other FROM customer)
SELECT c_custkey, {round6(fill('balance'))} AS x_balance, {round6('c_nationkey')} AS x_c_nationkey, {round6(fill('other'))} AS x_other,
       CASE WHEN balance IS NULL THEN 1.0 ELSE 0.0 END AS x_balance__missing, CASE WHEN other IS NULL THEN 1.0 ELSE 0.0 END AS x_other__missing FROM r"""


def _fold_split() -> str:
    return with_cte(FOLDS_CTE, """
SELECT reservation_id, CASE WHEN fold = 3 THEN 'val' ELSE 'dev' END AS side
FROM tf WHERE fold IS NOT NULL""")


def _rmse_by_fold() -> str:
    return with_cte(FOLDS_CTE + "," + DEV_MEANS + f""",
scored AS (
  SELECT tf.fold, tf.amount_spent_per_room_night_scaled AS y, coalesce({_STANDIN}, dm.dev_mean) AS p
  FROM tf LEFT JOIN per ON tf.fold = per.fold AND tf.roomnights IS NOT DISTINCT FROM per.roomnights
  LEFT JOIN tot ON tf.roomnights IS NOT DISTINCT FROM tot.roomnights
  LEFT JOIN dm ON dm.fold = tf.fold
),
per_fold AS (SELECT fold, sqrt(avg((y - p) * (y - p))) AS rmse, count(*) AS n_rows FROM scored GROUP BY fold),
overall AS (SELECT sqrt(avg((y - p) * (y - p))) AS overall_rmse FROM scored),
mean_fold AS (SELECT avg(rmse) AS mean_fold_rmse FROM per_fold)""", f"""
SELECT fold, n_rows, {round6('rmse')} AS rmse, {round6('mean_fold_rmse')} AS mean_fold_rmse,
       {round6('overall_rmse')} AS overall_rmse
FROM per_fold, mean_fold, overall""")


def _average_predictions(name: str = "prediction", with_models: bool = True) -> str:
    return with_cte(FOLDS_CTE + "," + DEV_MEANS + f""",
test_rows AS (SELECT reservation_id, roomnights, unnest(range(10)) AS fold
              FROM prep WHERE train_set = 0),
long AS (
  SELECT t.reservation_id, coalesce({_STANDIN}, dm.dev_mean) AS p
  FROM test_rows t
  LEFT JOIN per ON per.fold = t.fold AND per.roomnights IS NOT DISTINCT FROM t.roomnights
  LEFT JOIN tot ON tot.roomnights IS NOT DISTINCT FROM t.roomnights
  LEFT JOIN dm ON dm.fold = t.fold
)""", f"""
SELECT reservation_id, {round6('avg(p)')} AS {name}{', count(p) AS n_models' if with_models else ''}
FROM long GROUP BY reservation_id""")


_GAIN_CTE = PREP_CTE + """,
gains AS (
  SELECT resort_id, CAST(sum(total_pax) AS BIGINT) AS gain_sum
  FROM prep GROUP BY resort_id
),
pct AS (
  SELECT resort_id, gain_sum,
         CAST(gain_sum AS DOUBLE) * CAST(100 AS DOUBLE)
           / nullif(CAST((SELECT sum(gain_sum) FROM gains) AS DOUBLE), 0.0) AS gain
  FROM gains
)"""


def _percent_of_total() -> str:
    return with_cte(_GAIN_CTE, f"SELECT resort_id, gain_sum, {round6('gain')} AS gain FROM pct")


def _top_importance() -> str:
    return with_cte(_GAIN_CTE, f"""
SELECT resort_id, {round6('gain')} AS gain FROM pct
ORDER BY gain DESC NULLS LAST, resort_id ASC LIMIT 25""")


def _describe_select(val: str, src: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {g}count({val}) AS n, {round6(f'avg({val})')} AS mean,
       {round6(f'stddev_samp({val})')} AS std, {round6(f'min({val})')} AS min,
       {round6(f'quantile_cont({val}, 0.25)')} AS p25,
       {round6(f'quantile_cont({val}, 0.5)')} AS p50,
       {round6(f'quantile_cont({val}, 0.75)')} AS p75,
       {round6(f'max({val})')} AS max
FROM {src} {grp}"""


def _describe_target() -> str:
    return with_cte(PREP_CTE + """,
trn AS (SELECT * FROM prep WHERE train_set = 1)""",
                    _describe_select("amount_spent_per_room_night_scaled", "trn", "ci_month"))


def _visits_per_entity() -> str:
    return with_cte(PREP_CTE + """,
visits AS (SELECT memberid, count(*) AS visits FROM prep WHERE memberid IS NOT NULL GROUP BY memberid)""",
                    _describe_select("visits", "visits", None))


def _key_overlap() -> str:
    return with_cte(CLEAN_CTE + """,
a AS (SELECT DISTINCT memberid FROM u WHERE train_set = 1 AND memberid IS NOT NULL),
b AS (SELECT DISTINCT memberid FROM u WHERE train_set = 0 AND memberid IS NOT NULL)""", """
SELECT CAST(count(*) FILTER (WHERE b.memberid IS NULL) AS BIGINT) AS only_left,
       CAST(count(*) FILTER (WHERE a.memberid IS NULL) AS BIGINT) AS only_right,
       CAST(count(*) FILTER (WHERE a.memberid IS NOT NULL AND b.memberid IS NOT NULL) AS BIGINT) AS both
FROM a FULL OUTER JOIN b ON a.memberid = b.memberid""")


def _profile_nulls() -> str:
    cols = _RAW_COLS + ["train_set"]
    parts = [f"SELECT '{c}' AS column_name, count(*) AS rows, "
             f"CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
             f"{round6(f'(count(*) - count({c})) / CAST(count(*) AS DOUBLE)')} AS null_share FROM u"
             for c in cols]
    return with_cte(CLEAN_CTE, "\nUNION ALL\n".join(parts))


FREQ_COLS = ("channel_code", "main_product_code", "member_age_buckets", "cluster_code",
             "resort_type_code")


def _frequency_compare() -> str:
    parts = [f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, train_set FROM u"
             for c in FREQ_COLS]
    return with_cte(CLEAN_CTE + f""",
longv AS ({' UNION ALL '.join(parts)}),
wide AS (
  SELECT attribute, value,
         CAST(count(*) FILTER (WHERE train_set = 1) AS BIGINT) AS n_train,
         CAST(count(*) FILTER (WHERE train_set = 0) AS BIGINT) AS n_test
  FROM longv GROUP BY attribute, value
),
totals AS (SELECT attribute, sum(n_train) AS tt, sum(n_test) AS te FROM wide GROUP BY attribute)""", f"""
SELECT w.attribute, w.value, w.n_train, w.n_test,
       {round6('w.n_train / nullif(CAST(t.tt AS DOUBLE), 0.0)')} AS share_train,
       {round6('w.n_test / nullif(CAST(t.te AS DOUBLE), 0.0)')} AS share_test
FROM wide w JOIN totals t ON w.attribute = t.attribute""")


def oracle_queries(group_specs: dict, fitted_specs: list) -> dict[str, str]:
    out = {
        "date_parse": _date_parse(),
        "calendar_parts": _calendar_parts(),
        "date_gaps": _date_gaps(),
        "reset_invalid_rows": _reset_invalid_rows(),
        "source_union": _source_union(),
        "impute_round": _impute_round(),
        "ratios": _ratios(),
        "ratios_as_observed": _ratios_as_observed(),
        "csv_roundtrip": _csv_roundtrip(),
        "schema_report": _schema_report(),
        "feature_projection": _feature_projection(),
        "sequence_shift_hot": _sequence_shift_hot(),
        "assemble_matrix": _assemble_matrix(),
        "stump_split": _stump_split(),
        "oof_coverage": _oof_coverage(),
        "refit_coverage": _refit_coverage(),
        "assemble_missing": _assemble_missing(),
        "even_folds": _even_folds(),
        "sketch_quantiles": _sketch_quantiles(),
        "oof_values": _oof_values(),
        "refit_values": _refit_values(),
        "importance_values": _importance_values(),
        "cv_rounds_values": _cv_rounds_values(),
        "written_importance": _written_importance(),
        "written_predictions": _average_predictions("amount", False),
        "visit_gaps": _visit_gaps(),
        "sequence_shift": _sequence_shift(),
        "first_seen_index": _first_seen_index(),
        "fold_members": _fold_members(),
        "fold_split": _fold_split(),
        "rmse_by_fold": _rmse_by_fold(),
        "average_predictions": _average_predictions(),
        "percent_of_total": _percent_of_total(),
        "top_importance": _top_importance(),
        "describe_target": _describe_target(),
        "visits_per_entity": _visits_per_entity(),
        "key_overlap": _key_overlap(),
        "profile_nulls": _profile_nulls(),
        "frequency_compare": _frequency_compare(),
    }
    out.update(_fitted(fitted_specs))
    for name, specs in group_specs.items():
        out[name] = group_back_sql(specs)
    return out
