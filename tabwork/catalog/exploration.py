"""EDA queries (§2.5) with DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda as D
from ..operators import profile as P
from .inputs import (LINEITEM_EDA_NUMERIC, LINEITEM_EDA_SQL,
                     lineitem_dirty, lineitem_eda, lineitem_with_dups, rounded)
from .profiling import ORACLE as PROF_SQL

PROFILE_COLS_SQL = PROF_SQL["profile_columns"]
PROFILE_DS_SQL = PROF_SQL["profile_dataset"]
EDA = f"({LINEITEM_EDA_SQL})"


def _flat(df):
    return rounded(df.withColumn("affected_columns", F.concat_ws("|", "affected_columns")))


def q_eda_missingness(spark, d):
    return rounded(D.eda_missingness(P.profile_columns(lineitem_dirty(spark, d))))


MISSINGNESS_SQL = f"""
SELECT column_name, CAST(round(missing_pct * n_rows) AS BIGINT) AS missing_count, round(missing_pct, 4) AS missing_pct,
  CASE WHEN missing_pct < 0.1 THEN 'MAR' WHEN missing_pct > 0.5 THEN 'MNAR' ELSE 'unknown' END AS pattern
FROM (SELECT column_name, n_rows, n_missing / n_rows AS missing_pct FROM ({PROFILE_COLS_SQL})) WHERE missing_pct > 0"""


def q_eda_issue_missing(spark, d):
    return _flat(D.eda_issue_missing(P.profile_columns(lineitem_dirty(spark, d))))


ISSUE_MISSING_SQL = f"""
SELECT 'missing_values' AS type, CASE WHEN mp > 0.5 THEN 'high' ELSE 'medium' END AS severity, column_name,
  'High missing rate: ' || column_name AS title, printf('%.1f%% of values missing in %s', mp * 100, column_name) AS detail,
  'cleaning' AS phase, round(mp, 4) AS metric, column_name AS affected_columns
FROM (SELECT column_name, n_missing / n_rows AS mp FROM ({PROFILE_COLS_SQL})) WHERE mp > 0.3"""


def q_eda_issue_duplicates(spark, d):
    return _flat(D.eda_issue_duplicates(P.profile_dataset(lineitem_with_dups(spark, d))))


ISSUE_DUP_SQL = f"""
SELECT 'duplicates' AS type, CASE WHEN s > 0.02 THEN 'medium' ELSE 'low' END AS severity, NULL::VARCHAR AS column_name,
  CAST(duplicate_rows AS VARCHAR) || ' duplicate rows detected' AS title,
  printf('Dataset contains %d duplicate rows (%.1f%% of data)', duplicate_rows, s * 100) AS detail,
  'cleaning' AS phase, round(s, 4) AS metric, '' AS affected_columns
FROM (SELECT duplicate_rows, duplicate_rows / greatest(row_count, 1) AS s FROM ({PROFILE_DS_SQL})) WHERE duplicate_rows > 0"""


def q_eda_correlation_matrix(spark, d):
    return rounded(D.eda_correlation_matrix(lineitem_eda(spark, d)))


def _corr_sql():
    cols = LINEITEM_EDA_NUMERIC
    parts = []
    for i, a in enumerate(cols):
        parts.append(f"SELECT '{a}' AS col_a, '{a}' AS col_b, CASE WHEN stddev_samp({a}) > 0 THEN 1.0 ELSE 0.0 END AS r FROM {EDA}")
        for b in cols[i + 1:]:
            r = f"coalesce(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0.0)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r} AS r FROM {EDA}")
            parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {r} AS r FROM {EDA}")
    return "SELECT col_a, col_b, round(r, 5) AS r FROM (" + " UNION ALL ".join(parts) + ")"


CORR_SQL = _corr_sql()


def q_eda_high_correlation(spark, d):
    df = lineitem_eda(spark, d)
    cols = LINEITEM_EDA_NUMERIC
    return rounded(D.eda_high_correlation(D.eda_correlation_matrix(df, cols), cols))


def _high_sql():
    order = "CASE {x} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(LINEITEM_EDA_NUMERIC)) + " END"
    return (f"SELECT col_a, col_b, r FROM ({CORR_SQL}) WHERE {order.format(x='col_a')} < {order.format(x='col_b')} "
            "AND abs(r) > 0.9")


def q_eda_issue_correlation(spark, d):
    df = lineitem_eda(spark, d)
    cols = LINEITEM_EDA_NUMERIC
    return _flat(D.eda_issue_correlation(D.eda_high_correlation(D.eda_correlation_matrix(df, cols), cols)))


ISSUE_CORR_SQL = f"""
SELECT 'correlation' AS type, 'high' AS severity, NULL::VARCHAR AS column_name,
  printf('High correlation between %d feature pair(s)', n) AS title,
  'Highly correlated features may cause multicollinearity. Consider dropping one.' AS detail,
  'features' AS phase, 0.9 AS metric, cols AS affected_columns
FROM (SELECT count(*) AS n, array_to_string(list_sort(list_distinct(list(col_a))), '|') AS cols FROM ({_high_sql()}))
WHERE n > 0"""


def q_eda_target_distribution(spark, d):
    return D.eda_target_distribution(lineitem_eda(spark, d), "l_quantity")


TARGET_DIST_SQL = f"""
SELECT CAST(l_quantity AS VARCHAR) AS label, count(*) AS count FROM {EDA} WHERE l_quantity IS NOT NULL
GROUP BY 1 ORDER BY count DESC, label LIMIT 20"""


def q_eda_issue_imbalance(spark, d):
    return _flat(D.eda_issue_imbalance(D.eda_target_counts(lineitem_eda(spark, d), "big_disc"), "big_disc"))


IMB_SQL = f"""
WITH td AS (SELECT CAST(big_disc AS VARCHAR) AS label, count(*) AS c FROM {EDA} GROUP BY 1),
a AS (SELECT count(*) AS k, max(c) / greatest(min(c), 1) AS ratio FROM td)
SELECT 'class_imbalance' AS type, CASE WHEN ratio > 10 THEN 'high' ELSE 'medium' END AS severity,
  'big_disc' AS column_name, 'Class imbalance detected in ''big_disc''' AS title,
  printf('Majority class is %.1fx larger than minority class. Consider SMOTE or class weighting.', ratio) AS detail,
  'sampling' AS phase, round(ratio, 2) AS metric, 'big_disc' AS affected_columns
FROM a WHERE k BETWEEN 2 AND 20 AND ratio > 3"""


def q_eda_issue_low_variance(spark, d):
    return _flat(D.eda_issue_low_variance(P.profile_columns(lineitem_dirty(spark, d))))


LOWVAR_SQL = f"""
SELECT 'low_variance' AS type, 'low' AS severity, column_name, 'Near-zero variance: ' || column_name AS title,
  printf('Column ''%s'' has near-constant values — low predictive power.', column_name) AS detail,
  'features' AS phase, 0.0 AS metric, column_name AS affected_columns
FROM ({PROFILE_COLS_SQL}) WHERE inferred_type = 'numeric' AND warnings LIKE '%Near-zero variance%'"""


def q_eda_issues(spark, d):
    dirty = lineitem_dirty(spark, d)
    pc = P.profile_columns(dirty)
    eda = lineitem_eda(spark, d)
    cols = LINEITEM_EDA_NUMERIC
    frames = [D.eda_issue_missing(pc), D.eda_issue_duplicates(P.profile_dataset(lineitem_with_dups(spark, d))),
              D.eda_issue_correlation(D.eda_high_correlation(D.eda_correlation_matrix(eda, cols), cols)),
              D.eda_issue_imbalance(D.eda_target_counts(eda, "big_disc"), "big_disc"),
              D.eda_issue_low_variance(pc)]
    return _flat(D.eda_issues(*frames))


ISSUES_SQL = " UNION ALL ".join(f"SELECT * FROM ({s})" for s in
                                [ISSUE_MISSING_SQL, ISSUE_DUP_SQL, ISSUE_CORR_SQL, IMB_SQL, LOWVAR_SQL])

MI_FEATURES = [c for c in LINEITEM_EDA_NUMERIC]


def q_eda_mutual_information(spark, d):
    return rounded(D.eda_mutual_information(lineitem_eda(spark, d), "l_returnflag"))


def _mi_sql(features, target, src, numeric_target=False, top=30, rnd=True):
    stats, longs = [], []
    for i, f in enumerate(features + ([target] if numeric_target else [])):
        x = f"CAST({f} AS DOUBLE)"
        stats.append(f"quantile_cont({x}, 0.5) AS m{i}, quantile_cont({x}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e{i}, "
                     f"count(DISTINCT {x}) AS d{i}")

    def binned(i, f):
        v = f"coalesce(CAST({f} AS DOUBLE), m{i})"
        return (f"CASE WHEN d{i} <= 20 THEN CAST({v} AS VARCHAR) "
                f"ELSE CAST(len(list_filter(e{i}, lambda e: {v} > e)) AS VARCHAR) END")
    y = binned(len(features), target) if numeric_target else f"CAST({target} AS VARCHAR)"
    for i, f in enumerate(features):
        longs.append(f"SELECT {y} AS y, '{f}' AS feature, {binned(i, f)} AS x FROM t, st")
    return f"""
WITH t AS (SELECT * FROM {src} WHERE {target} IS NOT NULL),
st AS (SELECT {", ".join(stats)} FROM t),
l AS ({" UNION ALL ".join(longs)}),
nxy AS (SELECT feature, x, y, count(*) AS n FROM l GROUP BY ALL),
m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny,
        sum(n) OVER (PARTITION BY feature) AS nt FROM nxy),
mi AS (SELECT feature, greatest(sum(n / nt * ln(n * nt / (nx * ny))), 0.0) AS mi FROM m GROUP BY feature)
SELECT feature, {"round(mi, 5)" if rnd else "mi"} AS mi FROM mi ORDER BY mi DESC, feature LIMIT {top}"""


def q_eda_abs_correlation_rank(spark, d):
    return rounded(D.eda_abs_correlation_rank(lineitem_eda(spark, d), "big_disc"))


ABS_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(abs(coalesce(corr(CAST({f} AS DOUBLE), CAST(big_disc AS DOUBLE)), 0.0)), 5) AS score FROM {EDA}"
    for f in LINEITEM_EDA_NUMERIC if f != "big_disc")


def q_eda_feature_overrides(spark, d):
    mi = D.eda_mutual_information(lineitem_eda(spark, d), "l_returnflag")
    ov = spark.createDataFrame([("l_discount", "include"), ("l_orderkey", "exclude")], "feature string, override string")
    return rounded(D.eda_feature_overrides(mi, ov))


OVERRIDES_SQL = f"""
SELECT m.feature, m.mi, coalesce(o.override, 'auto') AS override
FROM ({_mi_sql(MI_FEATURES, 'l_returnflag', EDA)}) m
LEFT JOIN (VALUES ('l_discount', 'include'), ('l_orderkey', 'exclude')) o(feature, override) ON m.feature = o.feature"""


QUERIES = {
    "eda_missingness": q_eda_missingness,
    "eda_issue_missing": q_eda_issue_missing,
    "eda_issue_duplicates": q_eda_issue_duplicates,
    "eda_correlation_matrix": q_eda_correlation_matrix,
    "eda_high_correlation": q_eda_high_correlation,
    "eda_issue_correlation": q_eda_issue_correlation,
    "eda_target_distribution": q_eda_target_distribution,
    "eda_issue_imbalance": q_eda_issue_imbalance,
    "eda_issue_low_variance": q_eda_issue_low_variance,
    "eda_issues": q_eda_issues,
    "eda_mutual_information": q_eda_mutual_information,
    "eda_abs_correlation_rank": q_eda_abs_correlation_rank,
    "eda_feature_overrides": q_eda_feature_overrides,
}

ORACLE = {
    "eda_missingness": MISSINGNESS_SQL,
    "eda_issue_missing": ISSUE_MISSING_SQL,
    "eda_issue_duplicates": ISSUE_DUP_SQL,
    "eda_correlation_matrix": CORR_SQL,
    "eda_high_correlation": _high_sql(),
    "eda_issue_correlation": ISSUE_CORR_SQL,
    "eda_target_distribution": TARGET_DIST_SQL,
    "eda_issue_imbalance": IMB_SQL,
    "eda_issue_low_variance": LOWVAR_SQL,
    "eda_issues": ISSUES_SQL,
    "eda_mutual_information": _mi_sql(MI_FEATURES, "l_returnflag", EDA),
    "eda_abs_correlation_rank": ABS_SQL,
    "eda_feature_overrides": OVERRIDES_SQL,
}
