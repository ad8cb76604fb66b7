"""Evaluation queries (§2.11) over formula-scored lineitem rows, with DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from .inputs import (SCORED_BINARY_SQL, SCORED_MULTICLASS_SQL, SCORED_OVR_SQL,
                     SCORED_REGRESSION_SQL, rounded, scored_binary, scored_binary_sql,
                     scored_multiclass, scored_ovr, scored_regression)

SB = f"({SCORED_BINARY_SQL})"
SM = f"({SCORED_MULTICLASS_SQL})"


def _case_sum(x: str, edges, op: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {x} {op} {e!r} THEN 1 ELSE 0 END" for e in edges) + ")"


# ------------------------------------------------------------------ accuracy, folds
def q_eval_accuracy(spark, d):
    return rounded(E.eval_accuracy(scored_binary(spark, d), ["model", "fold"]))


ACC_SQL = f"""SELECT model, fold, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 5) AS accuracy,
count(*) AS n FROM {SB} GROUP BY model, fold"""


def q_cv_fold_summary(spark, d):
    return rounded(E.cv_fold_summary(scored_binary(spark, d), ["model"]))


FOLD_SQL = f"""SELECT model, count(*) AS n_folds, round(avg(a), 5) AS mean, round(stddev_pop(a), 5) AS std,
round(min(a), 5) AS min, round(max(a), 5) AS max FROM (
  SELECT model, fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a FROM {SB} GROUP BY model, fold)
GROUP BY model"""


# ------------------------------------------------------------------ multiclass
def q_eval_per_class(spark, d):
    return rounded(E.eval_per_class(scored_multiclass(spark, d), ["model"]))


PC_BASE = f"""
WITH s AS {SM},
cls AS (SELECT model, label AS class FROM s UNION SELECT model, prediction FROM s),
c AS (SELECT c.model, c.class,
        sum(CASE WHEN s.label = c.class AND s.prediction = c.class THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN s.label = c.class THEN 1 ELSE 0 END) AS support,
        sum(CASE WHEN s.prediction = c.class THEN 1 ELSE 0 END) AS predicted
      FROM cls c JOIN s ON s.model = c.model GROUP BY c.model, c.class),
m AS (SELECT model, class, support,
        CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1 FROM m)"""

PC_SQL = PC_BASE + """
SELECT model, class, round(precision, 5) AS precision, round(recall, 5) AS recall, round(f1, 5) AS f1,
CAST(support AS BIGINT) AS support FROM pc"""


def q_eval_macro_weighted(spark, d):
    return rounded(E.eval_macro_weighted(scored_multiclass(spark, d), ["model"]))


MW_SQL = PC_BASE + """
SELECT model, round(avg(f1), 5) AS macro_f1,
  round(sum(precision * support) / greatest(sum(support), 1), 5) AS weighted_precision,
  round(sum(recall * support) / greatest(sum(support), 1), 5) AS weighted_recall,
  round(sum(f1 * support) / greatest(sum(support), 1), 5) AS weighted_f1
FROM pc GROUP BY model"""


def q_eval_f1_weighted(spark, d):
    return rounded(E.eval_f1_weighted(scored_multiclass(spark, d), ["model"]))


F1W_SQL = PC_BASE + """
SELECT model, round(sum(f1 * support) / greatest(sum(support), 1), 5) AS weighted_f1 FROM pc GROUP BY model"""


def q_eval_confusion_matrix(spark, d):
    return rounded(E.eval_confusion_matrix(scored_multiclass(spark, d), ["model"]))


CM_SQL = f"""
WITH s AS {SM},
cls AS (SELECT model, label AS c FROM s UNION SELECT model, prediction FROM s),
cnt AS (SELECT model, label AS actual, prediction AS predicted, count(*) AS n FROM s GROUP BY ALL),
tot AS (SELECT model, count(*) AS total FROM s GROUP BY model)
SELECT a.model, a.c AS actual, p.c AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS count,
  round(coalesce(n, 0) / greatest(total, 1) * 100, 5) AS pct
FROM cls a JOIN cls p ON a.model = p.model
LEFT JOIN cnt ON cnt.model = a.model AND cnt.actual = a.c AND cnt.predicted = p.c
JOIN tot ON tot.model = a.model"""


def q_eval_confusion_cells(spark, d):
    return rounded(E.eval_confusion_cells(scored_multiclass(spark, d), ["model"]))


CELLS_SQL = f"""
WITH s AS {SM}
SELECT model, label AS actual, prediction AS predicted, count(*) AS count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY model) * 100, 5) AS pct,
  CAST(sum(count(*)) OVER (PARTITION BY model, label) AS BIGINT) AS actual_rows,
  CAST(sum(count(*)) OVER (PARTITION BY model, prediction) AS BIGINT) AS predicted_rows
FROM s GROUP BY model, label, prediction"""


# ------------------------------------------------------------------ thresholds
def _sweep_sql(thresholds):
    arr = ", ".join(repr(float(t)) for t in thresholds)
    return f"""
WITH s AS {SB}, t AS (SELECT unnest([{arr}]) AS threshold),
c AS (SELECT model, threshold,
  sum(CASE WHEN probability >= threshold AND label = 1.0 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN probability >= threshold AND label <> 1.0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN probability < threshold AND label = 1.0 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN probability < threshold AND label <> 1.0 THEN 1 ELSE 0 END) AS tn
  FROM s, t GROUP BY model, threshold),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT model, threshold, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
FROM m"""


def _round_sql(inner: str, cols: list[str], keep: list[str]) -> str:
    return "SELECT " + ", ".join(keep + [f"round({c}, 5) AS {c}" for c in cols]) + f" FROM ({inner})"


def q_eval_threshold_sweep(spark, d):
    return rounded(E.eval_threshold_sweep(scored_binary(spark, d), E.TRAINER_THRESHOLDS, ["model"]))


SWEEP_SQL = _round_sql(_sweep_sql(E.TRAINER_THRESHOLDS), ["threshold", "precision", "recall", "f1", "fpr"],
                       ["model", "tp", "fp", "fn", "tn"])


def q_eval_threshold_sweep_fine(spark, d):
    return rounded(E.eval_threshold_sweep(scored_binary(spark, d), E.EVALUATOR_THRESHOLDS, ["model"]))


SWEEP_FINE_SQL = _round_sql(_sweep_sql(E.EVALUATOR_THRESHOLDS),
                            ["threshold", "precision", "recall", "f1", "fpr"],
                            ["model", "tp", "fp", "fn", "tn"])


def q_eval_optimal_threshold(spark, d):
    sw = E.eval_threshold_sweep(scored_binary(spark, d), E.EVALUATOR_THRESHOLDS, ["model"])
    return rounded(E.eval_optimal_threshold(sw, ["model"]))


OPT_SQL = f"""
SELECT model, round(arg_min(threshold, (-f1, threshold)), 5) AS optimal_threshold, round(max(f1), 5) AS best_f1
FROM ({_sweep_sql(E.EVALUATOR_THRESHOLDS)}) GROUP BY model"""


def q_eval_business_impact(spark, d):
    sw = E.eval_threshold_sweep(scored_binary(spark, d), [0.5], ["model"])
    return rounded(E.eval_business_impact(sw.select("model", "tp", "fp", "fn", "tn")))


BIZ_SQL = f"""
WITH c AS (SELECT model, CAST(tp AS DOUBLE) tp, CAST(fp AS DOUBLE) fp, CAST(fn AS DOUBLE) fn,
                  CAST(tn AS DOUBLE) tn, tp AS tp0, fp AS fp0, fn AS fn0, tn AS tn0
           FROM ({_sweep_sql([0.5])})),
v AS (SELECT *, tp * 100 - fp * 10 - fn * 50 + tn * 0 AS net, tp + fp + fn + tn AS total,
             (tp + fn) / greatest(tp + fp + fn + tn, 1.0) AS pf FROM c),
r AS (SELECT *, total * pf * pf * 100 - total * (1 - pf) * pf * 10 - total * pf * (1 - pf) * 50
               + total * (1 - pf) * (1 - pf) * 0 AS rnd FROM v)
SELECT model, tp0 AS tp, fp0 AS fp, fn0 AS fn, tn0 AS tn, round(net, 5) AS net_impact,
  round(rnd, 5) AS random_impact,
  round(CASE WHEN rnd <> 0 THEN (net - rnd) / abs(rnd) * 100 ELSE 0.0 END, 5) AS lift_pct
FROM r"""


# ------------------------------------------------------------------ histograms, calibration
HIST_EDGES = E.uniform_edges(20)
CAL_EDGES = E.uniform_edges(10)


def q_eval_prediction_histogram(spark, d):
    return rounded(E.eval_prediction_histogram(scored_binary(spark, d), 20, ["model"]))


HIST_BASE = f"""
WITH s AS {SB},
c AS (SELECT model, CAST(least({_case_sum('probability', HIST_EDGES[1:-1], '>=')}, 19) AS BIGINT) AS bin_index,
        sum(CASE WHEN label = 1.0 THEN 1 ELSE 0 END) AS cp, sum(CASE WHEN label = 1.0 THEN 0 ELSE 1 END) AS cn
      FROM s GROUP BY ALL),
g AS (SELECT model, CAST(b AS BIGINT) AS bin_index FROM (SELECT DISTINCT model FROM s), range(20) t(b)),
h AS (SELECT g.model, g.bin_index,
        round(([{", ".join(repr(round((HIST_EDGES[i] + HIST_EDGES[i + 1]) / 2, 3)) for i in range(20))}])[g.bin_index + 1], 5) AS bin,
        CAST(coalesce(cp, 0) AS BIGINT) AS count_positive, CAST(coalesce(cn, 0) AS BIGINT) AS count_negative
      FROM g LEFT JOIN c ON c.model = g.model AND c.bin_index = g.bin_index)"""

HIST_SQL = HIST_BASE + " SELECT * FROM h"


def q_eval_separation_quality(spark, d):
    h = E.eval_prediction_histogram(scored_binary(spark, d), 20, ["model"])
    return rounded(E.eval_separation_quality(h, ["model"]))


SEP_SQL = HIST_BASE + """,
a AS (SELECT model, sum(CASE WHEN bin > 0.5 THEN count_positive ELSE 0 END) AS pa, sum(count_positive) AS pt
      FROM h GROUP BY model),
q AS (SELECT model, CASE WHEN pt > 0 THEN pa / pt ELSE 0.0 END AS sep FROM a)
SELECT model, round(sep, 5) AS separation,
  CASE WHEN sep > 0.8 THEN 'Excellent separation' WHEN sep > 0.6 THEN 'Good separation'
       ELSE 'Poor separation' END AS verdict FROM q"""


def q_eval_calibration(spark, d):
    return rounded(E.eval_calibration(scored_binary(spark, d), 10, ["model"]))


CAL_BASE = f"""
WITH s AS {SB},
cal AS (SELECT model, CAST({_case_sum('probability', CAL_EDGES[1:-1], '>')} AS BIGINT) AS bin_index,
          avg(probability) AS mean_predicted, avg(CASE WHEN label = 1.0 THEN 1.0 ELSE 0.0 END) AS fraction_positive,
          count(*) AS n
        FROM s GROUP BY ALL)"""

CAL_SQL = CAL_BASE + """
SELECT model, bin_index, round(mean_predicted, 5) AS mean_predicted,
  round(fraction_positive, 5) AS fraction_positive, n FROM cal"""


def q_eval_calibration_error(spark, d):
    cal = E.eval_calibration(scored_binary(spark, d), 10, ["model"])
    return rounded(E.eval_calibration_error(cal, ["model"]))


CALERR_SQL = CAL_BASE + """,
e AS (SELECT model, avg(abs(mean_predicted - fraction_positive)) AS err FROM cal GROUP BY model)
SELECT model, round(err, 5) AS calibration_error,
  CASE WHEN err < 0.05 THEN 'Well Calibrated' WHEN err < 0.10 THEN 'Moderate' ELSE 'Poorly Calibrated' END AS verdict
FROM e"""


# ------------------------------------------------------------------ curves and AUC
def q_eval_roc_curve(spark, d):
    return rounded(E.eval_roc_curve(scored_binary(spark, d), ["model"]))


def _curve_sql(src: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""
WITH s AS {src},
sc AS (SELECT {sel}CAST(probability AS DOUBLE) AS score, sum(CASE WHEN label = 1.0 THEN 1 ELSE 0 END) AS pos,
          sum(CASE WHEN label = 1.0 THEN 0 ELSE 1 END) AS neg FROM s GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pc,
               sum(neg) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS nc,
               sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N FROM sc)"""


ROC_SQL = _curve_sql(SB, "model") + """
SELECT model, round(score, 5) AS score, round(CASE WHEN N > 0 THEN nc / N ELSE 0.0 END, 5) AS fpr,
  round(CASE WHEN P > 0 THEN pc / P ELSE 0.0 END, 5) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, NULL, 0.0, 0.0 FROM cum"""

TAX_SQL = f"({scored_binary_sql(['tax'])})"


def q_eval_pr_curve(spark, d):
    """Single model, no grouping: exercises the bucketed global running sum."""
    return rounded(E.eval_pr_curve(scored_binary(spark, d, ["tax"])))


PR_SQL = _curve_sql(TAX_SQL, "") + """
SELECT round(score, 5) AS score, round(CASE WHEN P > 0 THEN pc / P ELSE 0.0 END, 5) AS recall,
  round(CASE WHEN pc + nc > 0 THEN pc / (pc + nc) ELSE 0.0 END, 5) AS precision FROM cum
UNION ALL SELECT NULL, 0.0, 1.0"""


def q_eval_pr_auc(spark, d):
    s = scored_binary(spark, d)
    return rounded(E.eval_pr_auc(s, ["model"]))


PRAUC_SQL = _curve_sql(SB, "model") + """,
pts AS (SELECT model, score, CASE WHEN P > 0 THEN pc / P ELSE 0.0 END AS recall,
          CASE WHEN pc + nc > 0 THEN pc / (pc + nc) ELSE 0.0 END AS precision FROM cum
        UNION ALL SELECT DISTINCT model, NULL, 0.0, 1.0 FROM cum),
seg AS (SELECT model, recall, precision,
          lag(recall) OVER (PARTITION BY model ORDER BY score ASC NULLS LAST) AS r0,
          lag(precision) OVER (PARTITION BY model ORDER BY score ASC NULLS LAST) AS p0 FROM pts)
SELECT model, round(abs(coalesce(sum(abs(recall - r0) * ((precision + p0) / 2)), 0.0)), 5) AS pr_auc
FROM seg GROUP BY model"""


def q_eval_auc_roc(spark, d):
    return rounded(E.eval_auc_roc(scored_binary(spark, d), ["model"]))


def _auc_sql(src: str, by: str, lab: str = "label = 1.0", score: str = "probability") -> str:
    return f"""
WITH s AS {src},
sc AS (SELECT {by}, CAST({score} AS DOUBLE) AS score, sum(CASE WHEN {lab} THEN 1 ELSE 0 END) AS pos,
          sum(CASE WHEN {lab} THEN 0 ELSE 1 END) AS neg FROM s GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS UNBOUNDED PRECEDING) AS nc FROM sc),
a AS (SELECT {by}, sum(pos * (nc - neg + 0.5 * neg)) AS u, sum(pos) AS P, sum(neg) AS N FROM cum GROUP BY ALL)"""


AUC_SQL = _auc_sql(SB, "model") + """
SELECT model, round(CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END, 5) AS auc,
  CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg FROM a"""


def q_eval_auc_ovr(spark, d):
    return rounded(E.eval_auc_ovr(scored_ovr(spark, d)))


OVR_SQL = _auc_sql(f"({SCORED_OVR_SQL})", "class", "label = class", "score") + """,
per AS (SELECT class, CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END AS auc, P, N FROM a)
SELECT class, round(auc, 5) AS auc, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg,
  round((SELECT sum(auc * P) / sum(P) FROM per), 5) AS auc_weighted FROM per"""


# ------------------------------------------------------------------ regression
def q_eval_r2_rmse_mae(spark, d):
    return rounded(E.eval_r2_rmse_mae(scored_regression(spark, d), ["fold"]))


REG_SQL = f"""
SELECT fold, round(1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*)), 5) AS r2,
  round(sqrt(sum((label - prediction) ^ 2) / count(*)), 5) AS rmse,
  round(avg(abs(label - prediction)), 5) AS mae, count(*) AS n
FROM ({SCORED_REGRESSION_SQL}) GROUP BY fold"""


# ------------------------------------------------------------------ model comparison
def q_eval_mcnemar(spark, d):
    return rounded(E.eval_mcnemar(scored_binary(spark, d, ["disc", "tax"]), "disc", "tax"), 4)


def _erfc_sql(z: str) -> str:
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1.0 / (1.0 + 0.5 * abs({z})))"
    poly = f"{coef[-1]!r}"
    for c in reversed(coef[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    ans = f"({t} * exp(-abs({z}) * abs({z}) + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


MCN_SQL = f"""
WITH s AS {SB},
j AS (SELECT a.label, a.prediction AS pa, b.prediction AS pb FROM s a JOIN s b ON a.id = b.id
      WHERE a.model = 'disc' AND b.model = 'tax'),
c AS (SELECT CAST(sum(CASE WHEN pa = label AND pb <> label THEN 1 ELSE 0 END) AS BIGINT) AS ab,
             CAST(sum(CASE WHEN pa <> label AND pb = label THEN 1 ELSE 0 END) AS BIGINT) AS ba FROM j),
st AS (SELECT *, CASE WHEN ab + ba > 0 THEN (abs(ab - ba) - 1) ^ 2 / (ab + ba) ELSE 0.0 END AS statistic FROM c),
p AS (SELECT *, CASE WHEN ab + ba > 0 THEN {_erfc_sql('sqrt(statistic / 2)')} ELSE 1.0 END AS p_value FROM st)
SELECT 'disc' AS model_a, 'tax' AS model_b, ab, ba, round(statistic, 4) AS statistic,
  round(p_value, 4) AS p_value, p_value < 0.05 AS significant FROM p"""


def _candidates(spark, d):
    per_fold = E.eval_accuracy(scored_binary(spark, d), ["model", "fold"])
    return per_fold.groupBy(F.col("model").alias("model_name")).agg(
        F.avg("accuracy").alias("cv_score"), F.max("accuracy").alias("train_score"))


def q_eval_leaderboard(spark, d):
    return rounded(E.eval_leaderboard(_candidates(spark, d)))


LB_SQL = f"""
WITH pf AS (SELECT model, fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a FROM {SB} GROUP BY ALL),
c AS (SELECT model AS model_name, avg(a) AS cv_score, max(a) AS train_score FROM pf GROUP BY model),
r AS (SELECT *, row_number() OVER (ORDER BY cv_score DESC, model_name) AS rank FROM c)
SELECT model_name, round(cv_score, 5) AS cv_score, round(train_score, 5) AS train_score, CAST(rank AS BIGINT) AS rank,
  CASE WHEN rank = 1 THEN 'champion' WHEN rank <= 3 THEN 'challenger' ELSE 'dropped' END AS status,
  (train_score - cv_score) > 0.10 AS overfit, round(train_score - cv_score, 5) AS overfit_gap FROM r"""


QUERIES = {
    "eval_accuracy": q_eval_accuracy,
    "cv_fold_summary": q_cv_fold_summary,
    "eval_per_class": q_eval_per_class,
    "eval_macro_weighted": q_eval_macro_weighted,
    "eval_f1_weighted": q_eval_f1_weighted,
    "eval_confusion_matrix": q_eval_confusion_matrix,
    "eval_confusion_cells": q_eval_confusion_cells,
    "eval_threshold_sweep": q_eval_threshold_sweep,
    "eval_threshold_sweep_fine": q_eval_threshold_sweep_fine,
    "eval_optimal_threshold": q_eval_optimal_threshold,
    "eval_business_impact": q_eval_business_impact,
    "eval_prediction_histogram": q_eval_prediction_histogram,
    "eval_separation_quality": q_eval_separation_quality,
    "eval_calibration": q_eval_calibration,
    "eval_calibration_error": q_eval_calibration_error,
    "eval_roc_curve": q_eval_roc_curve,
    "eval_pr_curve": q_eval_pr_curve,
    "eval_pr_auc": q_eval_pr_auc,
    "eval_auc_roc": q_eval_auc_roc,
    "eval_auc_ovr": q_eval_auc_ovr,
    "eval_r2_rmse_mae": q_eval_r2_rmse_mae,
    "eval_mcnemar": q_eval_mcnemar,
    "eval_leaderboard": q_eval_leaderboard,
}

ORACLE = {
    "eval_accuracy": ACC_SQL,
    "cv_fold_summary": FOLD_SQL,
    "eval_per_class": PC_SQL,
    "eval_macro_weighted": MW_SQL,
    "eval_f1_weighted": F1W_SQL,
    "eval_confusion_matrix": CM_SQL,
    "eval_confusion_cells": CELLS_SQL,
    "eval_threshold_sweep": SWEEP_SQL,
    "eval_threshold_sweep_fine": SWEEP_FINE_SQL,
    "eval_optimal_threshold": OPT_SQL,
    "eval_business_impact": BIZ_SQL,
    "eval_prediction_histogram": HIST_SQL,
    "eval_separation_quality": SEP_SQL,
    "eval_calibration": CAL_SQL,
    "eval_calibration_error": CALERR_SQL,
    "eval_roc_curve": ROC_SQL,
    "eval_pr_curve": PR_SQL,
    "eval_pr_auc": PRAUC_SQL,
    "eval_auc_roc": AUC_SQL,
    "eval_auc_ovr": OVR_SQL,
    "eval_r2_rmse_mae": REG_SQL,
    "eval_mcnemar": MCN_SQL,
    "eval_leaderboard": LB_SQL,
}
