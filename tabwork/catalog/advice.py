"""Advisor queries (§2.6) over lineitem with missing values plus a price stored as
text and a 0/1 column; oracles rebuild the enriched profile frame in DuckDB."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisor as A
from .inputs import LINEITEM_DIRTY_COLS, LINEITEM_DIRTY_SQL, lineitem_dirty, rounded
from .profiling import _columns_sql

ADV_COLS = LINEITEM_DIRTY_COLS + [("price_text", "string", "string"), ("is_return", "int", "numeric")]
ADV_SQL = (f"(SELECT *, CAST(l_extendedprice AS VARCHAR) AS price_text, "
           f"CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return FROM ({LINEITEM_DIRTY_SQL})) t")


def adv_input(spark, d):
    return lineitem_dirty(spark, d).select(
        "*", F.col("l_extendedprice").cast("string").alias("price_text"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_return"))


def frame(spark, d):
    return A.advisor_frame(adv_input(spark, d))


def _frame_sql() -> str:
    prof = _columns_sql(ADV_COLS, ADV_SQL)
    vc = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {ADV_SQL} "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c, _, _ in ADV_COLS)
    id_re = A.ID_PATTERN.replace("(?i)", "")
    dt_re = A.DATE_PATTERN.replace("(?i)", "")
    return f"""
WITH p AS ({prof}),
vc AS ({vc}),
r AS (SELECT vc.*, row_number() OVER (PARTITION BY vc.column_name ORDER BY count DESC, value) AS rk, p.n_rows
      FROM vc JOIN p ON vc.column_name = p.column_name),
ag AS (SELECT column_name, max(count) AS top1_count,
          sum(CASE WHEN count < greatest(n_rows * 0.01, 1.0) THEN 1 ELSE 0 END) AS rare_count,
          list(value ORDER BY rk) FILTER (WHERE rk <= 5) AS top_values,
          min(count) FILTER (WHERE rk <= 2) AS top2_min_count FROM r GROUP BY column_name),
f AS (SELECT p.*, top1_count, rare_count, top_values, top2_min_count FROM p LEFT JOIN ag ON p.column_name = ag.column_name)
SELECT *,
  regexp_matches(replace(column_name, '_', ' '), '{id_re}', 'i')
    OR (unique_count / greatest(n_rows, 1) > 0.95 AND inferred_type IN ('numeric', 'categorical')) AS id_like,
  inferred_type = 'datetime' OR regexp_matches(replace(column_name, '_', ' '), '{dt_re}', 'i') AS datetime_like,
  unique_count <= 1 OR coalesce(top1_count, 0) / greatest(n_rows - n_missing, 1) > 0.97 AS constant,
  inferred_type IN ('categorical', 'text') AND unique_count / greatest(n_rows, 1) > 0.5 AS high_cardinality
FROM f"""


FRAME = f"({_frame_sql()})"


def _flag_query(col):
    return lambda spark, d: frame(spark, d).select("column_name", col)


def _flag_sql(col):
    return f"SELECT column_name, {col} FROM {FRAME}"


def _j(*items):
    return "concat_ws('; ', " + ", ".join(items) + ")"


def q_target_candidates(spark, d):
    return rounded(A.adv_target_candidates(frame(spark, d)))


CAND_SQL = f"""
WITH f AS {FRAME},
s AS (SELECT *, round(greatest(0.0, least(1.0, 0.5 - CASE WHEN id_like THEN 0.4 ELSE 0 END - CASE WHEN datetime_like THEN 0.35 ELSE 0 END
   - CASE WHEN constant THEN 0.5 ELSE 0 END - CASE WHEN missing_pct > 0.30 THEN 0.2 ELSE 0 END - CASE WHEN inferred_type = 'text' THEN 0.3 ELSE 0 END
   + CASE WHEN unique_count = 2 THEN 0.4 WHEN unique_count BETWEEN 3 AND 20 AND inferred_type = 'categorical' THEN 0.3
          WHEN inferred_type = 'numeric' THEN 0.25 WHEN unique_count > 20 AND inferred_type = 'categorical' THEN -0.1 ELSE 0 END
   + CASE WHEN missing_pct < 0.05 THEN 0.1 ELSE 0 END)), 3) AS score FROM f)
SELECT column_name, position, round(score, 5) AS score,
  CASE WHEN unique_count = 2 THEN 'classification' WHEN unique_count BETWEEN 3 AND 20 AND inferred_type = 'categorical' THEN 'classification'
       WHEN inferred_type = 'numeric' THEN 'regression' ELSE 'classification' END AS inferred_task,
  {_j("CASE WHEN unique_count = 2 THEN 'Binary target — ideal for classification' END",
      "CASE WHEN unique_count <> 2 AND unique_count BETWEEN 3 AND 20 AND inferred_type = 'categorical' THEN printf('Multiclass target (%d classes)', unique_count) END",
      "CASE WHEN unique_count <> 2 AND NOT (unique_count BETWEEN 3 AND 20 AND inferred_type = 'categorical') AND inferred_type = 'numeric' THEN 'Continuous numeric — regression candidate' END",
      "CASE WHEN missing_pct < 0.05 THEN 'Low missing values' END",
      "CASE WHEN NOT id_like AND NOT datetime_like THEN 'Not ID-like or time-based' END")} AS reasons,
  {_j("CASE WHEN id_like THEN printf('''%s'' looks like an identifier — models cannot predict IDs meaningfully', column_name) END",
      "CASE WHEN datetime_like THEN printf('''%s'' appears time-based — did you mean Time Series Forecasting?', column_name) END",
      "CASE WHEN constant THEN printf('''%s'' is near-constant — model would learn trivial predictions', column_name) END",
      "CASE WHEN missing_pct > 0.30 THEN printf('''%s'' has %.0f%% missing values', column_name, missing_pct * 100) END",
      "CASE WHEN inferred_type = 'text' THEN printf('''%s'' is free text — not suitable as a classification target without preprocessing', column_name) END",
      "CASE WHEN unique_count > 20 AND inferred_type = 'categorical' AND unique_count <> 2 THEN printf('High cardinality (%d classes) — may be difficult to predict', unique_count) END")} AS warnings,
  row_number() OVER (ORDER BY score DESC, position) AS rank,
  row_number() OVER (ORDER BY score DESC, position) = 1 AND score > 0.4 AS is_recommended
FROM s"""


def q_task_recommendation(spark, d):
    return A.adv_task_recommendation(frame(spark, d), "l_linestatus")


TASK_SQL = f"""
SELECT column_name,
  CASE WHEN datetime_like THEN 'forecasting' WHEN unique_count = 2 THEN 'classification'
       WHEN unique_count BETWEEN 3 AND 20 AND inferred_type = 'categorical' THEN 'classification'
       WHEN inferred_type = 'numeric' AND unique_count > 20 THEN 'regression' ELSE 'classification' END AS task,
  CAST(CASE WHEN datetime_like THEN 85 WHEN unique_count = 2 THEN 95 WHEN unique_count BETWEEN 3 AND 20 AND inferred_type = 'categorical' THEN 88
       WHEN inferred_type = 'numeric' AND unique_count > 20 THEN 90 ELSE 55 END AS BIGINT) AS confidence,
  CASE WHEN datetime_like THEN 'Target appears time-based; Time ordering detected'
       WHEN unique_count = 2 THEN 'Target has exactly 2 unique values; Values are categorical (binary); No ordering detected' ||
         CASE WHEN coalesce(top2_min_count / greatest(n_rows, 1) > 0.1, FALSE) THEN '; Classes appear reasonably balanced' ELSE '' END
       WHEN unique_count BETWEEN 3 AND 20 AND inferred_type = 'categorical' THEN printf('Target has %d unique values; Values are categorical; Suitable for multiclass classification', unique_count)
       WHEN inferred_type = 'numeric' AND unique_count > 20 THEN printf('Target is continuous numeric; High cardinality (%d unique values); No natural class boundaries detected', unique_count)
       ELSE 'Could not clearly infer task — defaulting to classification' END AS why
FROM {FRAME} WHERE column_name = 'l_linestatus'"""


def _dist_sql(target):
    return f"""
WITH vc AS (SELECT CAST({target} AS VARCHAR) AS label, count(*) AS count FROM {ADV_SQL} WHERE {target} IS NOT NULL GROUP BY 1),
t AS (SELECT *, round(count / sum(count) OVER () * 100, 1) AS pct, count(*) OVER () AS k FROM vc),
m AS (SELECT *, CASE WHEN k >= 2 THEN min(pct) OVER () ELSE 50.0 END AS mpct FROM t)
SELECT label, count, round(pct, 5) AS pct,
  CASE WHEN k < 2 THEN 'none' WHEN mpct < 10 THEN 'severe' WHEN mpct < 25 THEN 'moderate' WHEN mpct < 40 THEN 'mild' ELSE 'none' END AS imbalance,
  round(mpct, 1) AS minority_pct FROM m"""


def q_target_distribution(spark, d):
    return rounded(A.adv_target_distribution(adv_input(spark, d), "l_returnflag"))


def q_imbalance_severity(spark, d):
    return rounded(A.adv_imbalance_severity(A.adv_target_distribution(adv_input(spark, d), "l_linenumber")))


IMB_SEV_SQL = f"""
WITH d AS ({_dist_sql('l_linenumber')}), o AS (SELECT first(imbalance) AS severity, first(minority_pct) AS minority_pct FROM d)
SELECT severity, minority_pct,
  CASE WHEN severity IN ('moderate', 'severe') THEN 'Class weights; SMOTE oversampling; Random undersampling'
       WHEN severity = 'mild' THEN 'Class weights; Stratified split' ELSE '' END AS techniques,
  CASE WHEN severity IN ('moderate', 'severe') THEN 'F1 Score' ELSE 'Accuracy' END AS recommended_metric,
  CASE WHEN severity IN ('moderate', 'severe') THEN 'Imbalanced dataset — accuracy is misleading' ELSE 'Balanced classes' END AS metric_reason
FROM o"""


def q_quality_warnings(spark, d):
    return A.adv_quality_warnings(frame(spark, d))


QW_SQL = f"""
SELECT column_name, 'missing_values' AS type, CASE WHEN missing_pct > 0.40 THEN 'high' ELSE 'medium' END AS severity,
  printf('High missing values in ''%s'' (%.0f%%)', column_name, missing_pct * 100) AS message FROM {FRAME} WHERE missing_pct > 0.20
UNION ALL
SELECT column_name, 'constant_column', 'medium', printf('''%s'' is near-constant — likely uninformative', column_name) FROM {FRAME} WHERE constant"""

NUMS = [c for c, _, k in ADV_COLS if k == "numeric"]


def corrs(spark, d, target="l_discount"):
    return A.target_correlations(adv_input(spark, d), NUMS, target)


def _corr_sql(target="l_discount"):
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), CAST({target} AS DOUBLE))) AS correlation FROM {ADV_SQL}) "
        f"WHERE correlation IS NOT NULL AND NOT isnan(correlation)" for c in NUMS if c != target)


def q_leakage(spark, d):
    return rounded(A.adv_leakage_by_corr(corrs(spark, d)))


LEAK_SQL = f"""SELECT feature, round(correlation, 3) AS correlation, 'high' AS severity,
printf('''%s'' is highly correlated with target (%.2f) — possible data leakage', feature, correlation) AS message
FROM ({_corr_sql()}) WHERE correlation > 0.85"""


def q_top_features(spark, d):
    return rounded(A.adv_top_features(corrs(spark, d)))


TOPF_SQL = f"SELECT feature, round(correlation, 3) AS correlation FROM ({_corr_sql()})"


def q_problem_difficulty(spark, d):
    fr = frame(spark, d)
    return A.adv_problem_difficulty_frame(fr, A.adv_target_distribution(adv_input(spark, d), "l_discount"), corrs(spark, d))


def _difficulty_sql():
    parts = [("n_rows < 500", 25, "Very small dataset"), ("n_rows >= 500 AND n_rows < 5000", 10, "Small dataset"),
             ("n_rows > 50000", -10, "Large dataset — good for training"), ("n_features < 5", 15, "Few features available"),
             ("n_features > 50", 5, "Many features — selection important"),
             ("coalesce(imbalance IN ('moderate', 'severe'), FALSE)", 15, "Class imbalance present"),
             ("coalesce(top_corr > 0.7, FALSE)", -10, "Strong predictive signals found"),
             ("top_corr IS NULL OR top_corr < 0.2", 10, "Weak predictive signals")]
    score = "50 + " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in parts)
    return f"""
WITH b AS (SELECT (SELECT max(n_rows) FROM {FRAME}) AS n_rows, (SELECT count(*) - 1 FROM {FRAME}) AS n_features,
  (SELECT first(imbalance) FROM ({_dist_sql('l_discount')})) AS imbalance, (SELECT max(correlation) FROM ({_corr_sql()})) AS top_corr),
s AS (SELECT *, greatest(0, least(100, {score})) AS score FROM b)
SELECT CASE WHEN score < 35 THEN 'Easy' WHEN score < 60 THEN 'Medium' ELSE 'Hard' END AS level, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN score < 35 THEN 90 WHEN score < 60 THEN 78 ELSE 62 END AS BIGINT) AS baseline_accuracy,
  {_j(*[f"CASE WHEN {c} THEN '{t}' END" for c, _, t in parts])} AS reasons FROM s"""


def q_type_summary(spark, d):
    return A.adv_type_summary(frame(spark, d))


TYPES_SQL = f"""SELECT {", ".join(f"CAST(sum(CASE WHEN inferred_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}" for t in ("numeric", "categorical", "datetime", "text", "boolean"))},
  coalesce(array_to_string(list_sort(list(column_name) FILTER (WHERE high_cardinality)), ','), '') AS high_cardinality,
  coalesce(array_to_string(list_sort(list(column_name) FILTER (WHERE constant)), ','), '') AS constant_columns FROM {FRAME}"""

OUT_PCT = "CASE WHEN abs(coalesce(skewness, 0)) > 3 THEN 8.0 WHEN abs(coalesce(skewness, 0)) > 2 THEN 4.0 WHEN abs(coalesce(skewness, 0)) > 1 THEN 1.5 ELSE 0.0 END"
OUT_SUG = ("CASE WHEN min IS NOT NULL AND min > 0 AND coalesce(skewness, 0) > 1.5 THEN 'log' WHEN coalesce(skewness, 0) > 2.5 THEN 'clip' "
           "WHEN abs(coalesce(skewness, 0)) > 1 THEN 'sqrt' END")
OUT_OK = "inferred_type = 'numeric' AND std IS NOT NULL AND std >= 1e-8"
RARE = "round(coalesce(rare_count, 0) / greatest(unique_count, 1) * 100, 1)"
ENC = ("CASE WHEN unique_count <= 2 THEN 'binary' WHEN unique_count <= 10 THEN 'one-hot' WHEN unique_count <= 50 "
       "THEN 'target encoding (recommended) or label encoding' ELSE 'target encoding or hashing (high cardinality)' END")
HEALTH = (f"CASE WHEN id_like THEN 'drop' WHEN unique_count > n_rows * 0.5 THEN 'problematic' WHEN {RARE} > 50 THEN 'review' "
          "ELSE 'ok' END")


def q_outlier_hint(spark, d):
    return rounded(A.adv_outlier_hint(frame(spark, d), adv_input(spark, d)))


def _outlier_sql():
    nums = NUMS
    shares = " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, avg(CASE WHEN x IS NOT NULL THEN CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END END) AS s
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {ADV_SQL}), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {ADV_SQL})"""
                        for c in nums)
    return f"""
SELECT f.column_name, {OUT_PCT} AS outlier_pct_est, round(round(coalesce(skewness, 0.0), 2), 5) AS skewness,
  {OUT_SUG} AS suggested_transform, round(s.s, 5) AS iqr_outlier_share
FROM {FRAME} f LEFT JOIN ({shares}) s ON f.column_name = s.column_name WHERE {OUT_OK}"""


def q_cardinality_health(spark, d):
    return rounded(A.adv_cardinality_health(frame(spark, d)))


CARD_SQL = f"""SELECT column_name, unique_count, round({RARE}, 5) AS rare_category_pct, {ENC} AS suggested_encoding, {HEALTH} AS health
FROM {FRAME} WHERE inferred_type IN ('categorical', 'text')"""


def q_feature_quality(spark, d):
    top = A.adv_top_features(corrs(spark, d))
    return A.adv_feature_quality(frame(spark, d), top)


def _quality_sql():
    zero = "(inferred_type = 'numeric' AND std IS NOT NULL AND std < 1e-8)"
    sk = "abs(coalesce(skewness, 0))"
    base = (f"100 - CASE WHEN missing_pct > 0.40 THEN 35 WHEN missing_pct > 0.20 THEN 20 WHEN missing_pct > 0.05 THEN 8 ELSE 0 END"
            f" - CASE WHEN constant THEN 40 WHEN {zero} THEN 30 ELSE 0 END - CASE WHEN id_like THEN 25 ELSE 0 END"
            f" - CASE WHEN high_cardinality THEN 15 ELSE 0 END - CASE WHEN inferred_type = 'numeric' AND {sk} > 3 THEN 10 ELSE 0 END")
    issues = _j("CASE WHEN missing_pct > 0.40 THEN printf('Very high missing (%.0f%%)', missing_pct * 100) WHEN missing_pct > 0.20 THEN printf('High missing (%.0f%%)', missing_pct * 100) WHEN missing_pct > 0.05 THEN printf('Moderate missing (%.0f%%)', missing_pct * 100) END",
                f"CASE WHEN constant THEN 'Near-constant — no predictive value' WHEN {zero} THEN 'Zero variance' END",
                "CASE WHEN id_like THEN 'Likely identifier column' END", "CASE WHEN high_cardinality THEN 'Very high cardinality' END",
                f"CASE WHEN inferred_type = 'numeric' AND {sk} > 3 THEN 'Extreme skew — transform recommended' END")
    return f"""
WITH t AS (SELECT feature FROM ({TOPF_SQL})),
s AS (SELECT f.*, greatest(0, CASE WHEN t.feature IS NOT NULL THEN least(100, {base} + 10) ELSE {base} END) AS score, {issues} AS issues
      FROM {FRAME} f LEFT JOIN t ON f.column_name = t.feature)
SELECT column_name, CAST(score AS BIGINT) AS score, CASE WHEN score >= 75 THEN 'Good' WHEN score >= 45 THEN 'Review' ELSE 'Problematic' END AS grade,
  issues FROM s"""


def q_feature_preview(spark, d):
    return rounded(A.adv_feature_preview(frame(spark, d)))


PREVIEW_SQL = f"""
SELECT column_name, inferred_type AS type, round(round(missing_pct * 100, 1), 5) AS missing_pct, unique_count,
  constant AS is_constant, id_like AS is_id_like, datetime_like AS is_datetime,
  CASE WHEN inferred_type = 'numeric' THEN min END AS min, CASE WHEN inferred_type = 'numeric' THEN max END AS max,
  inferred_type = 'numeric' AND abs(coalesce(skewness, 0)) > 1.0 AS skewed,
  inferred_type = 'numeric' AND abs(coalesce(skewness, 0)) > 2.0 AS outliers_likely,
  CASE WHEN {OUT_OK} THEN {OUT_PCT} END AS outlier_pct_est, CASE WHEN {OUT_OK} THEN {OUT_SUG} END AS suggested_transform,
  CASE WHEN inferred_type IN ('categorical', 'text') THEN coalesce(array_to_string(top_values, ','), '') END AS top_values,
  CASE WHEN inferred_type IN ('categorical', 'text') THEN {HEALTH} END AS cardinality_health,
  CASE WHEN inferred_type IN ('categorical', 'text') THEN {ENC} END AS suggested_encoding,
  CASE WHEN inferred_type IN ('categorical', 'text') THEN round({RARE}, 5) END AS rare_category_pct
FROM {FRAME}"""


def q_complexity(spark, d):
    return rounded(A.adv_complexity(frame(spark, d)))


COMPLEX_SQL = f"""
WITH a AS (SELECT count(*) AS f, max(n_rows) AS r, sum(CASE WHEN high_cardinality THEN 1 ELSE 0 END) AS hc FROM {FRAME})
SELECT CAST(f AS BIGINT) AS feature_count, CAST(r AS BIGINT) AS row_count, round(round(f / greatest(r, 1), 4), 5) AS feature_row_ratio,
  CASE WHEN r < f * 50 THEN printf('%d%% of recommended minimum (%s rows for %d features)', CAST(floor(r / greatest(f * 50, 1) * 100) AS INT),
       format('{{:,}}', f * 50), f) ELSE 'Sufficient' END AS sample_sufficiency,
  {_j("CASE WHEN f / greatest(r, 1) > 0.1 THEN printf('High feature-to-sample ratio (%d/%d) — risk of overfitting', f, r) END",
      "CASE WHEN r < 500 THEN 'Very small dataset — model reliability may be low' WHEN r < 2000 THEN 'Small dataset — prefer cross-validation over simple split' END",
      "CASE WHEN f > 100 THEN printf('High dimensionality (%d features) — curse of dimensionality risk', f) END",
      "CASE WHEN hc > 3 THEN printf('%d high-cardinality categorical columns may blow up feature space', hc) END")} AS warnings
FROM a"""


def q_dtype_issues(spark, d):
    return A.adv_dtype_issues(frame(spark, d))


def _dtype_sql():
    cur = A.CURRENCY_PATTERN.replace("(?i)", "")
    num = A.NUMERIC_TEXT_PATTERN
    return f"""
SELECT column_name, 'numeric_as_text' AS issue, 'medium' AS severity,
  printf('''%s'' appears numeric but stored as text — cast to float/int', column_name) AS message FROM {FRAME}
WHERE dtype = 'string' AND inferred_type IN ('categorical', 'text') AND len(coalesce(top_values, [])) > 0
  AND len(list_filter(top_values, lambda v: regexp_matches(v, '{num}'))) / len(top_values) >= 0.8
UNION ALL
SELECT column_name, 'currency_as_text', 'medium', printf('''%s'' looks like a currency column stored as text — strip symbols and cast', column_name)
FROM {FRAME} WHERE regexp_matches(replace(column_name, '_', ' '), '{cur}', 'i') AND dtype = 'string'
UNION ALL
SELECT column_name, 'boolean_as_numeric', 'low', printf('''%s'' has only 0/1 values — consider casting to boolean', column_name)
FROM {FRAME} WHERE inferred_type = 'numeric' AND unique_count = 2 AND min = 0 AND max = 1"""


def q_time_awareness(spark, d):
    return A.adv_time_awareness(frame(spark, d))


TIME_SQL = f"""SELECT count(*) FILTER (WHERE datetime_like) > 0 AS has_datetime,
coalesce(array_to_string(list_sort(list(column_name) FILTER (WHERE datetime_like)), ','), '') AS datetime_columns,
CASE WHEN count(*) FILTER (WHERE datetime_like) > 0 THEN 'time_aware' END AS recommended FROM {FRAME}"""


def q_smart_profile(spark, d):
    parts = A.adv_smart_profile(adv_input(spark, d), target="l_discount")
    out = None
    for name, df in parts.items():  # the whole profile: every row of every section, as JSON
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "adv_id_like": _flag_query("id_like"),
    "adv_datetime_like": _flag_query("datetime_like"),
    "adv_constant": _flag_query("constant"),
    "adv_high_cardinality": _flag_query("high_cardinality"),
    "adv_target_candidates": q_target_candidates,
    "adv_task_recommendation": q_task_recommendation,
    "adv_target_distribution": q_target_distribution,
    "adv_imbalance_severity": q_imbalance_severity,
    "adv_quality_warnings": q_quality_warnings,
    "adv_leakage_by_corr": q_leakage,
    "adv_top_features": q_top_features,
    "adv_problem_difficulty": q_problem_difficulty,
    "adv_type_summary": q_type_summary,
    "adv_feature_preview": q_feature_preview,
    "adv_feature_quality": q_feature_quality,
    "adv_outlier_hint": q_outlier_hint,
    "adv_complexity": q_complexity,
    "adv_dtype_issues": q_dtype_issues,
    "adv_cardinality_health": q_cardinality_health,
    "adv_time_awareness": q_time_awareness,
    "adv_smart_profile": q_smart_profile,
}

ORACLE = {
    "adv_id_like": _flag_sql("id_like"),
    "adv_datetime_like": _flag_sql("datetime_like"),
    "adv_constant": _flag_sql("constant"),
    "adv_high_cardinality": _flag_sql("high_cardinality"),
    "adv_target_candidates": CAND_SQL,
    "adv_task_recommendation": TASK_SQL,
    "adv_target_distribution": _dist_sql("l_returnflag"),
    "adv_imbalance_severity": IMB_SEV_SQL,
    "adv_quality_warnings": QW_SQL,
    "adv_leakage_by_corr": LEAK_SQL,
    "adv_top_features": TOPF_SQL,
    "adv_problem_difficulty": _difficulty_sql(),
    "adv_type_summary": TYPES_SQL,
    "adv_feature_preview": PREVIEW_SQL,
    "adv_feature_quality": _quality_sql(),
    "adv_outlier_hint": _outlier_sql(),
    "adv_complexity": COMPLEX_SQL,
    "adv_dtype_issues": _dtype_sql(),
    "adv_cardinality_health": CARD_SQL,
    "adv_time_awareness": TIME_SQL,
}
