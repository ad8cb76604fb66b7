"""Cleaning queries (§2.7, plus the drop/filter keys of §2.2) with DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as P
from ..plans import cleaning as CP
from ..operators.impute import DECIMALS, knn_impute
from .inputs import (GAPPY, LINEITEM_CLEAN_SRC_SQL, LINEITEM_GAPPY_SQL, lineitem_gappy, LINEITEM_OUTL_COLS, LINEITEM_OUTL_SQL,
                     lineitem_clean_src, lineitem_outl, rounded)

SRC = f"({LINEITEM_CLEAN_SRC_SQL})"
OUTL = f"({LINEITEM_OUTL_SQL})"
DOUBLE_COLS = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "tiny_disc", "l_price_outl"}


def _sel(cols, over=None):
    over = over or {}
    out = []
    for c in cols:
        e = over.get(c, c)
        if c in DOUBLE_COLS:
            out.append(f"round({e}, 5) AS {c}")
        elif c == "l_shipdate":
            out.append(f"strftime({e}, '%Y-%m-%d %H:%M:%S') AS {c}")
        else:
            out.append(f"{e} AS {c}")
    return ", ".join(out)


# ------------------------------------------------------------------ plan
def q_clean_plan(spark, d):
    df = lineitem_clean_src(spark, d)
    return CP.clean_plan(P.profile_columns(df), P.profile_dataset(df))


def _profile_sql():
    """Profile facts the planner reads, for every column of the cleaning source."""
    parts = []
    for pos, c in enumerate(LINEITEM_OUTL_COLS):
        numeric = c not in ("l_returnflag", "l_linestatus", "l_shipdate", "first_flag", "ship_str")
        x = f"CAST({c} AS DOUBLE)"
        sk = (f"CASE WHEN stddev_samp({x}) > 0 THEN skewness({x}) END" if numeric else "NULL::DOUBLE")
        std = f"stddev_samp({x})" if numeric else "NULL::DOUBLE"
        if c == "l_shipdate":
            itype = "'datetime'"
        elif c == "ship_str":
            itype = "'datetime'"
        elif numeric:
            itype = "'numeric'"
        else:
            itype = "'categorical'"
        parts.append(f"SELECT '{c}' AS column_name, {pos} AS position, count(*) AS n_rows, "
                     f"(count(*) - count({c})) / count(*) AS mp, count(DISTINCT {c}) AS uc, {sk} AS sk, "
                     f"{std} AS std, {itype} AS inferred_type FROM {SRC}")
    return " UNION ALL ".join(parts)


def _plan_sql():
    return f"""
WITH pc AS ({_profile_sql()}),
ds AS (SELECT count(*) AS row_count, (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM {SRC} GROUP BY {", ".join(LINEITEM_OUTL_COLS)})) AS dup FROM {SRC}),
w AS (SELECT *, inferred_type = 'numeric' AND std < 0.01 AND uc > 1 AS lowvar,
             uc / n_rows > 0.95 AND inferred_type <> 'numeric' AS highcard FROM pc)
SELECT 'duplicates:__all__' AS action_id, CAST(-1 AS BIGINT) AS seq, '__all__' AS column_name, 'duplicates' AS issue_type,
  format('{{:,}}', dup) || ' duplicate rows detected' AS issue_detail,
  CASE WHEN dup / greatest(row_count, 1) > 0.02 THEN 'medium' ELSE 'low' END AS severity, 'drop_rows' AS strategy,
  CAST(dup AS BIGINT) AS affected_rows, 'Remove ' || format('{{:,}}', dup) || ' exact duplicate rows' AS estimated_impact
FROM ds WHERE dup > 0
UNION ALL
SELECT 'missing_values:' || column_name, CAST(position * 10 AS BIGINT), column_name, 'missing_values',
  printf('%.1f%% missing — too high for imputation', mp * 100), 'high', 'drop_column', CAST(round(mp * n_rows) AS BIGINT),
  printf('Drop column ''%s'' (%.1f%% missing)', column_name, mp * 100)
FROM w WHERE mp > 0.5
UNION ALL
SELECT 'missing_values:' || column_name, CAST(position * 10 AS BIGINT), column_name, 'missing_values',
  printf('%.1f%% missing values', mp * 100), CASE WHEN mp > 0.3 THEN 'high' ELSE 'medium' END,
  CASE WHEN inferred_type = 'numeric' THEN 'median_impute' ELSE 'mode_impute' END, CAST(round(mp * n_rows) AS BIGINT),
  'Impute ' || format('{{:,}}', CAST(round(mp * n_rows) AS BIGINT)) || ' missing values with ' ||
  CASE WHEN inferred_type = 'numeric' THEN 'median' ELSE 'mode' END
FROM w WHERE mp > 0.05 AND mp <= 0.5
UNION ALL
SELECT 'low_variance:' || column_name, CAST(position * 10 + 1 AS BIGINT), column_name, 'low_variance',
  'Near-constant column — low predictive value', 'low', 'drop_column', CAST(0 AS BIGINT),
  printf('Drop low-variance column ''%s''', column_name)
FROM w WHERE lowvar
UNION ALL
SELECT 'high_cardinality:' || column_name, CAST(position * 10 + 2 AS BIGINT), column_name, 'high_cardinality',
  format('{{:,}}', uc) || ' unique values — may cause overfitting', 'medium', 'drop_column', CAST(0 AS BIGINT),
  'Drop high-cardinality column ''' || column_name || ''' (' || format('{{:,}}', uc) || ' unique values)'
FROM w WHERE highcard AND inferred_type IN ('categorical', 'text')
UNION ALL
SELECT 'outliers:' || column_name, CAST(position * 10 + 3 AS BIGINT), column_name, 'outliers',
  printf('Skewness = %.2f — likely outliers present', sk), CASE WHEN abs(sk) > 5 THEN 'medium' ELSE 'low' END,
  'clip_outliers', CAST(floor(n_rows * 0.01) AS BIGINT), printf('Clip extreme values in ''%s'' (skew=%.2f) to IQR bounds', column_name, sk)
FROM w WHERE inferred_type = 'numeric' AND sk IS NOT NULL AND abs(sk) > 3.0"""


# ------------------------------------------------------------------ apply
APPLY_ACTIONS = [
    {"action_id": "duplicates:__all__", "column_name": "__all__", "strategy": "drop_rows"},
    {"action_id": "missing_values:first_flag", "column_name": "first_flag", "strategy": "drop_column"},
    {"action_id": "missing_values:l_quantity", "column_name": "l_quantity", "strategy": "median_impute"},
    {"action_id": "low_variance:tiny_disc", "column_name": "tiny_disc", "strategy": "drop_column"},
    {"action_id": "outliers:l_price_outl", "column_name": "l_price_outl", "strategy": "clip_outliers"},
    {"action_id": "none:ship_str", "column_name": "ship_str", "strategy": "none"},
]
APPLY_OVERRIDES = {"missing_values:l_quantity": "mean_impute"}


def q_clean_apply(spark, d):
    return rounded(C.clean_apply(lineitem_clean_src(spark, d), APPLY_ACTIONS, APPLY_OVERRIDES))


def _clip(c, lo="lo", hi="hi"):
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END"


APPLY_KEEP = [c for c in LINEITEM_OUTL_COLS if c not in ("first_flag", "tiny_disc")]
CLEAN_APPLY_SQL = f"""
WITH t0 AS (SELECT DISTINCT * FROM {SRC}),
s AS (SELECT avg(l_quantity) AS m, quantile_cont(l_price_outl, 0.25) AS q1, quantile_cont(l_price_outl, 0.75) AS q3 FROM t0),
b AS (SELECT m, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s)
SELECT {_sel(APPLY_KEEP, {"l_quantity": "coalesce(l_quantity, m)", "l_price_outl": _clip("l_price_outl")})} FROM t0, b"""


def q_stage_audit(spark, d):
    before = lineitem_clean_src(spark, d)
    after = C.clean_apply(before, APPLY_ACTIONS, APPLY_OVERRIDES)
    return C.stage_audit(before, after, C._as_actions(APPLY_ACTIONS, APPLY_OVERRIDES))


AUDIT_SQL = f"""
SELECT (SELECT count(*) FROM {SRC}) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM {SRC})) AS rows_after,
  (SELECT count(*) FROM {SRC}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {SRC})) AS rows_removed,
  CAST({len(LINEITEM_OUTL_COLS)} AS BIGINT) AS cols_before, CAST({len(APPLY_KEEP)} AS BIGINT) AS cols_after,
  CAST(2 AS BIGINT) AS cols_removed, 'clip_outliers,drop_column,drop_rows,mean_impute,none' AS strategies"""


def q_clean_dedupe(spark, d):
    return rounded(C.clean_dedupe(lineitem_clean_src(spark, d)))


DEDUPE_SQL = f"SELECT {_sel(LINEITEM_OUTL_COLS)} FROM (SELECT DISTINCT * FROM {SRC})"


# single-strategy keys on lineitem_outl: output (rid, column)
def _single(col, strategy, **kw):
    def q(spark, d):
        out = C.strategy(lineitem_outl(spark, d), col, strategy, **kw)
        return rounded(out.select("rid", col))
    return q


def _single_sql(col, expr, stats="", where=""):
    w = f" WHERE {where}" if where else ""
    frm = f"{OUTL} t, ({stats}) s" if stats else f"{OUTL} t"
    return f"SELECT rid, {_sel([col], {col: expr})} FROM {frm}{w}"


def q_clean_knn_impute(spark, d):
    return rounded(knn_impute(lineitem_gappy(spark, d), GAPPY, k=KNN))


KNN = 5


def _knn_sql():
    """Every row with a gap against every donor: distances over shared columns by range, ties of the k-th included."""
    ranges = ", ".join(f"max({c}) - min({c}) AS r_{c}" for c in GAPPY)
    scaled = ", ".join(f"{c} / nullif(r_{c}, 0) AS v_{c}" for c in GAPPY)
    gap = lambda c: f"(a.v_{c} - b.v_{c}) * (a.v_{c} - b.v_{c})"
    total = " + ".join(f"coalesce({gap(c)}, 0)" for c in GAPPY)
    shared = " + ".join(f"(a.v_{c} IS NOT NULL AND b.v_{c} IS NOT NULL)::INTEGER" for c in GAPPY)
    d2 = f"round(({total}) * ({len(GAPPY)}.0::DOUBLE / ({shared})), {DECIMALS})"
    parts, filled = [], []
    for c in GAPPY:
        # equal donors are one, with a count and a sum: what is summed does not change
        donors = f"SELECT {', '.join(f'v_{o}' for o in GAPPY if o != c)}, NULL::DOUBLE AS v_{c}, count(*) AS m, sum({c}) AS s FROM v WHERE {c} IS NOT NULL GROUP BY ALL"
        parts.append(f"""p_{c} AS (SELECT rid, d2, sum(m) AS m, sum(s) AS s FROM (SELECT a.rid, {d2} AS d2, b.m, b.s
  FROM (SELECT * FROM v WHERE {c} IS NULL) a JOIN ({donors}) b ON ({shared}) > 0) GROUP BY rid, d2),
f_{c} AS (SELECT rid, sum(s) / sum(m) AS f FROM (SELECT *, coalesce(sum(m) OVER (PARTITION BY rid ORDER BY d2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM p_{c}) WHERE before < {KNN} GROUP BY rid)""")
        filled.append(f"round(coalesce(v.{c}, (SELECT f FROM f_{c} WHERE f_{c}.rid = v.rid), (SELECT median({c}) FROM v)), 5) AS {c}")
    return f"""
WITH g AS MATERIALIZED ({LINEITEM_GAPPY_SQL}), r AS (SELECT {ranges} FROM g), v AS MATERIALIZED (SELECT g.*, {scaled} FROM g, r),
{", ".join(parts)}
SELECT rid, {", ".join(filled)} FROM v"""


QUERIES = {
    "clean_knn_impute": q_clean_knn_impute,
    "clean_plan": q_clean_plan,
    "clean_apply": q_clean_apply,
    "stage_audit": q_stage_audit,
    "clean_dedupe": q_clean_dedupe,
    "clean_mean_impute": _single("l_quantity", "mean_impute"),
    "clean_median_impute": _single("l_quantity", "median_impute"),
    "clean_mode_impute": _single("first_flag", "mode_impute"),
    "clean_constant_fill": _single("l_quantity", "constant_fill"),
    "clean_forward_fill": _single("l_quantity", "forward_fill", order_by="rid"),
    "clean_backward_fill": _single("l_quantity", "backward_fill", order_by="rid"),
    "clean_clip_outliers": _single("l_price_outl", "clip_outliers"),
    "clean_remove_outliers": _single("l_price_outl", "remove_outliers"),
    "clean_drop_rows": _single("l_quantity", "drop_rows"),
    "clean_none": _single("l_quantity", "none"),
    "drop_columns": lambda spark, d: rounded(C.drop_columns(lineitem_outl(spark, d), ["first_flag", "ship_str", "tiny_disc"])),
    "drop_null_rows": lambda spark, d: rounded(C.drop_null_rows(lineitem_outl(spark, d), "first_flag").select("rid", "first_flag", "l_quantity")),
}

_Q = "SELECT quantile_cont(l_price_outl, 0.25) AS q1, quantile_cont(l_price_outl, 0.75) AS q3 FROM " + OUTL
_B = f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ({_Q})"
ORACLE = {
    "clean_knn_impute": _knn_sql(),
    "clean_plan": _plan_sql(),
    "clean_apply": CLEAN_APPLY_SQL,
    "stage_audit": AUDIT_SQL,
    "clean_dedupe": DEDUPE_SQL,
    "clean_mean_impute": _single_sql("l_quantity", "coalesce(l_quantity, m)", f"SELECT avg(l_quantity) AS m FROM {OUTL}"),
    "clean_median_impute": _single_sql("l_quantity", "coalesce(l_quantity, m)", f"SELECT quantile_cont(l_quantity, 0.5) AS m FROM {OUTL}"),
    "clean_mode_impute": _single_sql("first_flag", "coalesce(first_flag, m)",
                                     f"SELECT first_flag AS m FROM {OUTL} WHERE first_flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"),
    "clean_constant_fill": _single_sql("l_quantity", "coalesce(l_quantity, 0)"),
    "clean_forward_fill": _single_sql("l_quantity", "last_value(l_quantity IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "clean_backward_fill": _single_sql("l_quantity", "first_value(l_quantity IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    "clean_clip_outliers": _single_sql("l_price_outl", _clip("l_price_outl"), _B),
    "clean_remove_outliers": _single_sql("l_price_outl", "l_price_outl", _B, "l_price_outl >= lo AND l_price_outl <= hi"),
    "clean_drop_rows": _single_sql("l_quantity", "l_quantity", where="l_quantity IS NOT NULL"),
    "clean_none": _single_sql("l_quantity", "l_quantity"),
    "drop_columns": f"SELECT {_sel([c for c in LINEITEM_OUTL_COLS if c not in ('first_flag', 'ship_str', 'tiny_disc')])} FROM {OUTL}",
    "drop_null_rows": f"SELECT rid, first_flag, round(l_quantity, 5) AS l_quantity FROM {OUTL} WHERE first_flag IS NOT NULL",
}
