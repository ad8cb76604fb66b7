"""Monitoring, drift and active-learning queries (§2.13 and log keys of §2.2).

The prediction log is derived from the whole ``events`` table; the January
halves of ``events`` stand in for training baseline and serving traffic.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..session import table
from .inputs import rounded

# log columns: same formulas in Spark SQL and DuckDB
LOG_EXPRS = [
    ("id", "event_id"),
    ("prediction_id", "'p' || CAST(event_id AS STRING)"),
    ("deployment_id", "'dep' || CAST(user_id % 3 AS STRING)"),
    ("created_at", "ts"),
    ("confidence", "value / (value + 25)"),
    ("ground_truth", "CASE WHEN event_type = 'purchase' THEN '{\"label\": \"yes\"}' "
                     "WHEN event_type = 'signup' THEN '{\"label\": \"no\"}' END"),
]
LOG_SQL = ("SELECT " + ", ".join(f"{e} AS {c}" for c, e in LOG_EXPRS) +
           ", [value / (value + 25), (1 - value / (value + 25)) * 0.7, (1 - value / (value + 25)) * 0.3] AS probabilities"
           ", CAST(value AS VARCHAR) AS f_value, event_type AS f_event_type, json_extract_string(props, '$.k') AS f_k"
           " FROM events")
LOG = f"({LOG_SQL})"
SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
NUMERIC = ["value", "k"]
CATEG = ["event_type"]


def prediction_log(spark, d):
    ev = table(spark, d, "events")
    c = F.expr("value / (value + 25)")
    return ev.selectExpr(*[f"{e} AS {c}" for c, e in LOG_EXPRS], "value", "event_type", "props").select(
        "id", "prediction_id", "deployment_id", "created_at", "confidence", "ground_truth",
        F.array(c, (1 - c) * 0.7, (1 - c) * 0.3).alias("probabilities"),
        F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("event_type"), F.col("event_type"),
                     F.lit("k"), F.get_json_object("props", "$.k")).alias("input_features"))


def _long(spark, d, first_half: bool, feats):
    ev = table(spark, d, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    ev = ev.where(F.col("ts") < cut) if first_half else ev.where(F.col("ts") >= cut)
    m = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("event_type"), F.col("event_type"),
                     F.lit("k"), F.get_json_object("props", "$.k"), F.lit("weekday"),
                     F.weekday("ts").cast("string"))
    return ev.select(m.alias("input_features")).transform(lambda x: M.features_long(x, feats))


def _long_sql(first_half: bool, feats):
    op = "<" if first_half else ">="
    src = {"value": "CAST(value AS VARCHAR)", "event_type": "event_type", "k": "json_extract_string(props, '$.k')",
           "weekday": "CAST(isodow(ts) - 1 AS VARCHAR)"}
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {src[f]} AS value FROM events WHERE ts {op} {SPLIT}"
                              for f in feats)


def _psi_num_sql(base, cur):
    return f"""
WITH both_ AS (SELECT feature, CAST(value AS DOUBLE) AS v, 'b' AS side FROM ({base})
               UNION ALL SELECT feature, CAST(value AS DOUBLE), 'c' FROM ({cur})),
r AS (SELECT feature, min(v) AS mn, max(v) AS mx, sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS nb,
        sum(CASE WHEN side = 'c' THEN 1 ELSE 0 END) AS nc FROM both_ WHERE v IS NOT NULL GROUP BY feature),
cnt AS (SELECT b.feature, least(CAST(floor((v - mn) / ((mx - mn) / 10)) AS BIGINT), 9) AS bucket,
          sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS cb, sum(CASE WHEN side = 'c' THEN 1 ELSE 0 END) AS cc
        FROM both_ b JOIN r ON b.feature = r.feature WHERE v IS NOT NULL AND mx > mn GROUP BY ALL),
g AS (SELECT r.*, CAST(k AS BIGINT) AS bucket FROM r, range(10) t(k)),
j AS (SELECT g.*, (coalesce(cb, 0) + 1e-6) / nb AS pb, (coalesce(cc, 0) + 1e-6) / nc AS pc
      FROM g LEFT JOIN cnt ON g.feature = cnt.feature AND g.bucket = cnt.bucket)
SELECT feature, coalesce(sum(CASE WHEN mx > mn AND nb > 0 AND nc > 0 THEN (pc - pb) * ln(pc / pb) END), 0.0) AS psi
FROM j GROUP BY feature"""


def _psi_cat_sql(base, cur):
    return f"""
WITH fb AS (SELECT feature, value AS cat, count(*) AS cb FROM ({base}) GROUP BY ALL),
fc AS (SELECT feature, value AS cat, count(*) AS cc FROM ({cur}) GROUP BY ALL),
j AS (SELECT coalesce(fb.feature, fc.feature) AS feature, coalesce(cb, 0) AS cb, coalesce(cc, 0) AS cc
      FROM fb FULL OUTER JOIN fc ON fb.feature = fc.feature AND fb.cat = fc.cat),
t AS (SELECT *, sum(cb) OVER (PARTITION BY feature) AS nb, sum(cc) OVER (PARTITION BY feature) AS nc FROM j)
SELECT feature, sum(((cc + 1e-6) / greatest(nc, 1) - (cb + 1e-6) / greatest(nb, 1))
                    * ln(((cc + 1e-6) / greatest(nc, 1)) / ((cb + 1e-6) / greatest(nb, 1)))) AS psi
FROM t GROUP BY feature"""


def _level_sql(x):
    return f"CASE WHEN {x} < 0.1 THEN 'stable' WHEN {x} < 0.25 THEN 'warning' ELSE 'critical' END"


def q_drift_psi_numeric(spark, d):
    return rounded(M.psi_numeric(_long(spark, d, True, NUMERIC), _long(spark, d, False, NUMERIC)))


def q_drift_psi_categorical(spark, d):
    f = ["event_type", "weekday"]
    return rounded(M.psi_categorical(_long(spark, d, True, f), _long(spark, d, False, f)))


def q_drift_level(spark, d):
    num = M.psi_numeric(_long(spark, d, True, NUMERIC), _long(spark, d, False, NUMERIC))
    cat = M.psi_categorical(_long(spark, d, True, ["event_type", "weekday"]),
                            _long(spark, d, False, ["event_type", "weekday"]))
    out = num.unionByName(cat)
    return out.select("feature", M.drift_level(F.col("psi")).alias("drift_level"))


def q_drift_ks(spark, d):
    return rounded(M.drift_ks(_long(spark, d, True, NUMERIC), _long(spark, d, False, NUMERIC)))


KS_SQL = f"""
WITH both_ AS (SELECT feature, CAST(value AS DOUBLE) AS v, 1 AS ib FROM ({_long_sql(True, NUMERIC)})
               UNION ALL SELECT feature, CAST(value AS DOUBLE), 0 FROM ({_long_sql(False, NUMERIC)})),
c AS (SELECT feature, v, sum(ib) AS nb, sum(1 - ib) AS nc FROM both_ WHERE v IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, sum(nb) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS cb,
               sum(nc) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS cc,
               sum(nb) OVER (PARTITION BY feature) AS tb, sum(nc) OVER (PARTITION BY feature) AS tc FROM c)
SELECT feature, round(max(abs(cb / tb - cc / tc)), 5) AS ks, CAST(max(tb) AS BIGINT) AS n_baseline,
  CAST(max(tc) AS BIGINT) AS n_current FROM cum WHERE tb > 0 AND tc > 0 GROUP BY feature"""


def q_drift_report(spark, d):
    base = _long(spark, d, True, NUMERIC + CATEG)
    return rounded(M.drift_report(base, prediction_log(spark, d), NUMERIC, CATEG, n=500, deployment_id="dep0"))


def _report_sql():
    latest = f"(SELECT * FROM {LOG} WHERE deployment_id = 'dep0' ORDER BY created_at DESC, id DESC LIMIT 500)"
    cur_num = " UNION ALL ".join(f"SELECT '{f}' AS feature, f_{f} AS value FROM {latest}" for f in NUMERIC)
    cur_cat = " UNION ALL ".join(f"SELECT '{f}' AS feature, f_{f} AS value FROM {latest}" for f in CATEG)
    return f"""
WITH p AS (SELECT * FROM ({_psi_num_sql(_long_sql(True, NUMERIC), cur_num)})
           UNION ALL SELECT * FROM ({_psi_cat_sql(_long_sql(True, CATEG), cur_cat)}))
SELECT feature, round(psi, 5) AS psi, {_level_sql('psi')} AS drift_level,
  round((SELECT avg(psi) FROM p), 5) AS overall_drift FROM p"""


def q_latest_n_predictions(spark, d):
    out = M.latest_n_predictions(prediction_log(spark, d), 50, "dep2")
    return out.select("prediction_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def q_monitor_volume(spark, d):
    out = M.monitor_volume(prediction_log(spark, d), 12)
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "count")


VOLUME_SQL = f"""
WITH l AS {LOG}, e AS (SELECT date_trunc('hour', max(created_at)) AS end_ FROM l),
g AS (SELECT unnest(generate_series(end_ - INTERVAL 11 HOUR, end_, INTERVAL 1 HOUR)) AS hour FROM e),
c AS (SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM l GROUP BY 1)
SELECT strftime(g.hour, '%Y-%m-%d %H:%M:%S') AS hour, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.hour = c.hour"""


def q_monitor_rate_quantiles(spark, d):
    ev = table(spark, d, "events")
    out = M.monitor_rate_quantiles(ev, "value", "ts", F.col("event_type") == "error", "1 day")
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                              "p50", "p95", "p99", "per_minute", "error_rate"))


RATE_SQL = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95,
  round(quantile_cont(value, 0.99), 5) AS p99, round(count(*) / 1440.0, 5) AS per_minute,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 5) AS error_rate
FROM events GROUP BY date_trunc('day', ts)"""


def _score_query(strategy):
    def q(spark, d):
        log = prediction_log(spark, d)
        return rounded(log.select("prediction_id", M.uncertainty_score(strategy).alias("uncertainty_score")))
    return q


CONF_SQL_EXPR = "1.0 - coalesce(confidence, 1.0)"
ENT_SQL_EXPR = ("CASE WHEN len(probabilities) <= 1 THEN 0.0 ELSE -list_sum(list_transform(probabilities, "
                "lambda p: p * ln(p + 1e-12))) / ln(len(probabilities)) END")
MARGIN_SQL_EXPR = ("CASE WHEN len(probabilities) >= 2 THEN 1.0 - (list_reverse_sort(probabilities)[1] - "
                   "list_reverse_sort(probabilities)[2]) ELSE 1.0 - coalesce(confidence, 1.0) END")


def _score_sql(expr):
    return f"SELECT prediction_id, round({expr}, 5) AS uncertainty_score FROM {LOG}"


def q_uncertain_samples(spark, d):
    out = M.uncertain_samples(prediction_log(spark, d), n=20, strategy="margin", deployment_id="dep0")
    return rounded(out.select("prediction_id", "uncertainty_score", "confidence", "total_unlabeled"))


UNCERTAIN_SQL = f"""
WITH u AS (SELECT * FROM {LOG} WHERE ground_truth IS NULL AND deployment_id = 'dep0')
SELECT prediction_id, round({MARGIN_SQL_EXPR}, 5) AS uncertainty_score, round(confidence, 5) AS confidence,
  (SELECT count(*) FROM u) AS total_unlabeled
FROM u ORDER BY {MARGIN_SQL_EXPR} DESC, id LIMIT 20"""


def q_top_k_by_score(spark, d):
    log = prediction_log(spark, d)
    return rounded(M.top_k_by_score(log, M.uncertainty_score("entropy"), 25).select("prediction_id", "uncertainty_score"))


TOPK_SQL = f"SELECT prediction_id, round({ENT_SQL_EXPR}, 5) AS uncertainty_score FROM {LOG} ORDER BY {ENT_SQL_EXPR} DESC, id LIMIT 25"


def q_filter_unlabelled(spark, d):
    return rounded(M.filter_unlabelled(prediction_log(spark, d), "dep1").select("prediction_id", "confidence"))


FILTER_SQL = f"SELECT prediction_id, round(confidence, 5) AS confidence FROM {LOG} WHERE ground_truth IS NULL AND deployment_id = 'dep1'"

# label batch from click events: a first label, a later correction for some, and labels for unknown ids
LABEL_EXPRS = [
    ("SELECT 'p' || CAST(event_id AS STRING) AS prediction_id, "
     "'{\"label\": \"' || CASE WHEN value > 50 THEN 'yes' ELSE 'no' END || '\"}' AS ground_truth, "
     "ts + INTERVAL 1 DAY AS recorded_at FROM events WHERE event_type = 'click'"),
    ("SELECT 'p' || CAST(event_id AS STRING) AS prediction_id, '{\"label\": \"maybe\"}' AS ground_truth, "
     "ts + INTERVAL 2 DAY AS recorded_at FROM events WHERE event_type = 'click' AND user_id % 2 = 0"),
    ("SELECT 'q' || CAST(event_id AS STRING) AS prediction_id, '{\"label\": \"yes\"}' AS ground_truth, "
     "ts AS recorded_at FROM events WHERE event_type = 'view' AND value > 300"),
]


def label_batch(spark, d):
    """The same three label sources as ``LABEL_EXPRS``, built with DataFrame expressions."""
    ev = table(spark, d, "events")
    pid = F.concat(F.lit("p"), F.col("event_id").cast("string"))
    first = ev.where(F.col("event_type") == "click").select(
        pid.alias("prediction_id"),
        F.concat(F.lit('{"label": "'), F.when(F.col("value") > 50, "yes").otherwise("no"), F.lit('"}')).alias("ground_truth"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("recorded_at"))
    fix = ev.where((F.col("event_type") == "click") & (F.pmod("user_id", F.lit(2)) == 0)).select(
        pid.alias("prediction_id"), F.lit('{"label": "maybe"}').alias("ground_truth"),
        (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("recorded_at"))
    unknown = ev.where((F.col("event_type") == "view") & (F.col("value") > 300)).select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("prediction_id"),
        F.lit('{"label": "yes"}').alias("ground_truth"), F.col("ts").alias("recorded_at"))
    return first.unionByName(fix).unionByName(unknown)


LABELS_SQL = " UNION ALL ".join(LABEL_EXPRS)


def q_record_ground_truth(spark, d):
    upd, _ = M.record_ground_truth(prediction_log(spark, d), label_batch(spark, d))
    return upd.select("prediction_id", "ground_truth")


RGT_SQL = f"""
WITH n AS (SELECT prediction_id, arg_max(ground_truth, (recorded_at, ground_truth)) AS gt FROM ({LABELS_SQL}) GROUP BY 1)
SELECT l.prediction_id, coalesce(n.gt, l.ground_truth) AS ground_truth FROM {LOG} l LEFT JOIN n ON l.prediction_id = n.prediction_id"""


def q_record_ground_truth_unmatched(spark, d):
    _, un = M.record_ground_truth(prediction_log(spark, d), label_batch(spark, d))
    return un.select("prediction_id")


RGT_UN_SQL = f"""SELECT DISTINCT prediction_id FROM ({LABELS_SQL}) WHERE prediction_id NOT IN (SELECT prediction_id FROM {LOG})"""


def q_labelling_stats(spark, d):
    return rounded(M.labelling_stats(prediction_log(spark, d)))


STATS_SQL = f"""
SELECT deployment_id, count(*) AS total_predictions, CAST(count(ground_truth) AS BIGINT) AS labeled,
  CAST(count(*) - count(ground_truth) AS BIGINT) AS unlabeled, round(avg(confidence), 5) AS avg_confidence,
  round(count(ground_truth) / count(*), 5) AS review_rate FROM {LOG} GROUP BY deployment_id"""


def q_labelling_distribution(spark, d):
    return M.labelling_distribution(prediction_log(spark, d))


DIST_SQL = f"""
SELECT deployment_id, coalesce(json_extract_string(ground_truth, '$.label'), ground_truth) AS label, count(*) AS count
FROM {LOG} WHERE ground_truth IS NOT NULL GROUP BY ALL"""


QUERIES = {
    "drift_psi_numeric": q_drift_psi_numeric,
    "drift_psi_categorical": q_drift_psi_categorical,
    "drift_level": q_drift_level,
    "drift_ks": q_drift_ks,
    "drift_report": q_drift_report,
    "latest_n_predictions": q_latest_n_predictions,
    "monitor_volume": q_monitor_volume,
    "monitor_rate_quantiles": q_monitor_rate_quantiles,
    "uncertainty_confidence": _score_query("confidence"),
    "uncertainty_entropy": _score_query("entropy"),
    "uncertainty_margin": _score_query("margin"),
    "uncertain_samples": q_uncertain_samples,
    "top_k_by_score": q_top_k_by_score,
    "filter_unlabelled": q_filter_unlabelled,
    "record_ground_truth": q_record_ground_truth,
    "record_ground_truth_unmatched": q_record_ground_truth_unmatched,
    "labelling_stats": q_labelling_stats,
    "labelling_distribution": q_labelling_distribution,
}

_NUM_PSI = _psi_num_sql(_long_sql(True, NUMERIC), _long_sql(False, NUMERIC))
_CAT_PSI = _psi_cat_sql(_long_sql(True, ["event_type", "weekday"]), _long_sql(False, ["event_type", "weekday"]))
ORACLE = {
    "drift_psi_numeric": f"SELECT feature, round(psi, 5) AS psi FROM ({_NUM_PSI})",
    "drift_psi_categorical": f"SELECT feature, round(psi, 5) AS psi FROM ({_CAT_PSI})",
    "drift_level": f"SELECT feature, {_level_sql('psi')} AS drift_level FROM (SELECT * FROM ({_NUM_PSI}) UNION ALL SELECT * FROM ({_CAT_PSI}))",
    "drift_ks": KS_SQL,
    "drift_report": _report_sql(),
    "latest_n_predictions": f"""SELECT prediction_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM {LOG}
WHERE deployment_id = 'dep2' ORDER BY created_at DESC, id DESC LIMIT 50""",
    "monitor_volume": VOLUME_SQL,
    "monitor_rate_quantiles": RATE_SQL,
    "uncertainty_confidence": _score_sql(CONF_SQL_EXPR),
    "uncertainty_entropy": _score_sql(ENT_SQL_EXPR),
    "uncertainty_margin": _score_sql(MARGIN_SQL_EXPR),
    "uncertain_samples": UNCERTAIN_SQL,
    "top_k_by_score": TOPK_SQL,
    "filter_unlabelled": FILTER_SQL,
    "record_ground_truth": RGT_SQL,
    "record_ground_truth_unmatched": RGT_UN_SQL,
    "labelling_stats": STATS_SQL,
    "labelling_distribution": DIST_SQL,
}
