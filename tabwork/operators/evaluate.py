"""Evaluation over scored rows (survey §2.11).

Input is the ``scored`` table: ``id, label, prediction, probability`` plus
optional grouping columns such as ``model`` and ``fold`` (pass them in
``by``).  Every metric is an aggregate: rows are reduced map-side to counts
per (group, class) or per (group, distinct score) before any shuffle, and the
order-dependent curves run their running sums through the bucketed two-pass
scheme in ``functions.ordered`` rather than a single-task window.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import cumulative_sum

# Threshold grids and verdict bands of the reference.
TRAINER_THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
EVALUATOR_THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]  # 0.05 .. 0.95
OVERFIT_GAP = 0.10
CALIBRATION_BANDS = [(0.05, "Well Calibrated"), (0.10, "Moderate")]
CALIBRATION_WORST = "Poorly Calibrated"
SEPARATION_BANDS = [(0.8, "Excellent separation"), (0.6, "Good separation")]
SEPARATION_WORST = "Poor separation"
BUSINESS_DEFAULTS = dict(tp_benefit=100.0, fp_cost=10.0, fn_cost=50.0, tn_benefit=0.0)


def attach(big: DataFrame, small: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join a per-group frame (one row per group) back onto ``big``.

    The number of groups has no bound, so with keys the choice of a broadcast is left to
    Spark, which knows the size.  Without group keys ``small`` is one row and both sides get a
    constant key: a broadcast equi-join rather than a cartesian product.
    """
    if by:
        return big.join(small, list(by), how)
    return (big.withColumn("__k", F.lit(0))
            .join(F.broadcast(small.withColumn("__k", F.lit(0))), "__k", how).drop("__k"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def uniform_edges(n_bins: int) -> list[float]:
    """Bin edges exactly as numpy's ``linspace(0, 1, n+1)`` produces them."""
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def count_below(x: Column, edges: list[float], strict: bool = True) -> Column:
    """Number of ``edges`` below ``x`` (strict) or at most ``x``: a bin index."""
    arr = F.array(*[F.lit(e) for e in edges])
    if strict:
        return F.size(F.filter(arr, lambda e: e < x)).cast("long")
    return F.size(F.filter(arr, lambda e: e <= x)).cast("long")


# ---------------------------------------------------------------- classification
def eval_accuracy(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def class_counts(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., class, support, predicted, tp) over the union of true and predicted classes."""
    lab = F.col("label").cast("string")
    pred = F.col("prediction").cast("string")
    hit = (lab == pred).cast("long")
    long = scored.select(*by, F.explode(F.array(
        F.struct(lab.alias("class"), F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("tp")),
        F.struct(pred.alias("class"), F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("p"),
                 F.lit(0).cast("long").alias("tp")))).alias("r")).select(*by, "r.*")
    return long.groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"),
                                          F.sum("tp").alias("tp"))


def eval_per_class(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1, support per class; zero_division = 0."""
    cc = class_counts(scored, by)
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    return cc.select(*by, "class", prec.alias("precision"), rec.alias("recall"),
                     _safe_div(2 * prec * rec, prec + rec).alias("f1"), "support")


def eval_macro_weighted(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    pc = eval_per_class(scored, by)
    tot = F.greatest(F.sum("support"), F.lit(1))
    return pc.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("weighted_f1"))


def eval_f1_weighted(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    return eval_macro_weighted(scored, by).select(*by, "weighted_f1")


def eval_confusion_cells(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """The observed cells of the confusion matrix: count, % of all rows, rows of either class.

    At most as many rows as the data has pairs of (actual, predicted); cells without rows are left
    out, so it suits any number of classes.  Null classes are cells of their own.
    """
    by = list(by)
    lab, pred = F.col("label").cast("string"), F.col("prediction").cast("string")
    counts = scored.groupBy(*by, lab.alias("actual"), pred.alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.groupBy(*by).agg(F.sum("count").alias("total"))
    of = [counts.groupBy(*by, c).agg(F.sum("count").alias(f"{c}_rows")) for c in ("actual", "predicted")]
    out = counts
    for side, c in zip(of, ("actual", "predicted")):
        keys = [*by, c]
        side = side.select(*[F.col(k).alias(f"__{k}") for k in keys], f"{c}_rows")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = out.join(side, same).drop(*[f"__{k}" for k in keys])
    out = attach(out, total, by)
    return out.select(*by, "actual", "predicted", "count", (F.col("count") / F.col("total") * 100).alias("pct"), "actual_rows", "predicted_rows")


def eval_confusion_matrix(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Full grid over the union of classes: count and % of total.

    The square of the number of classes in rows; for very many classes see ``eval_confusion_cells``.
    The grid is a join of the distinct classes of a group with themselves.
    """
    by = list(by)
    lab, pred = F.col("label").cast("string"), F.col("prediction").cast("string")
    counts = scored.groupBy(*by, lab.alias("actual"), pred.alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    classes = (counts.select(*by, F.explode(F.array("actual", "predicted")).alias("c"))
               .where(F.col("c").isNotNull()).distinct().withColumn("__k", F.lit(0)))
    totals = counts.groupBy(*by).agg(F.sum("count").alias("total"))
    grid = (classes.withColumnRenamed("c", "actual").join(classes.withColumnRenamed("c", "predicted"), [*by, "__k"]).drop("__k"))
    keys = [*by, "actual", "predicted"]
    out = attach(grid.join(counts, keys, "left"), totals, by, "left")
    n = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    return out.select(*by, "actual", "predicted", n.alias("count"),
                      (n / F.greatest(F.col("total"), F.lit(1)) * 100).alias("pct"))


def score_counts(scored: DataFrame, by: list[str] = (), score: str = "probability",
                 positive: float = 1.0) -> DataFrame:
    """(by..., score, pos, neg): the binary scored table reduced to distinct scores."""
    is_pos = (F.col("label") == F.lit(positive))
    return scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(is_pos.cast("long")).alias("pos"), F.sum((~is_pos).cast("long")).alias("neg"))


def eval_threshold_sweep(scored: DataFrame, thresholds: list[float] = TRAINER_THRESHOLDS,
                         by: list[str] = (), score: str = "probability") -> DataFrame:
    """tp/fp/fn/tn, precision, recall, F1, FPR at each threshold (``p >= t``).

    Each row is mapped to the number of thresholds it clears, counted, and the
    tiny (group × bucket) frame is expanded over the thresholds.
    """
    ts = sorted(float(t) for t in thresholds)
    is_pos = (F.col("label") == 1.0)
    bucket = count_below(F.col(score).cast("double"), ts, strict=False)
    hist = scored.groupBy(*by, bucket.alias("b")).agg(
        F.sum(is_pos.cast("long")).alias("pos"), F.sum((~is_pos).cast("long")).alias("neg"))
    tarr = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("j"), F.lit(t).alias("threshold"))
                     for i, t in enumerate(ts)])
    ex = hist.select(*by, "b", "pos", "neg", F.explode(tarr).alias("t")).select(
        *by, "b", "pos", "neg", "t.j", "t.threshold")
    above = F.col("b") >= F.col("j")
    agg = ex.groupBy(*by, "threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"))
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(*by, "threshold", prec.alias("precision"), rec.alias("recall"),
                      _safe_div(2 * prec * rec, prec + rec).alias("f1"),
                      _safe_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
                      *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])


def eval_optimal_threshold(sweep: DataFrame, by: list[str] = ()) -> DataFrame:
    """First threshold with the highest F1."""
    return sweep.groupBy(*by).agg(
        F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("optimal_threshold"),
        F.max("f1").alias("best_f1"))


def eval_prediction_histogram(scored: DataFrame, n_bins: int = 20, by: list[str] = (),
                              score: str = "probability") -> DataFrame:
    """Score histogram by true class over numpy's uniform edges.

    Bin i holds ``edge[i] <= p < edge[i+1]``; the last bin is closed so p = 1
    is kept (quirk Q13).
    """
    edges = uniform_edges(n_bins)
    b = F.least(count_below(F.col(score).cast("double"), edges[1:-1], strict=False), F.lit(n_bins - 1))
    is_pos = F.col("label") == 1.0
    counted = scored.groupBy(*by, b.alias("bin_index")).agg(
        F.sum(is_pos.cast("long")).alias("count_positive"),
        F.sum((~is_pos).cast("long")).alias("count_negative"))
    centers = F.array(*[F.struct(F.lit(i).cast("long").alias("bin_index"),
                                 F.lit(round((edges[i] + edges[i + 1]) / 2, 3)).alias("bin"))
                        for i in range(n_bins)])
    groups = scored.select(*by).distinct() if by else scored.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(centers).alias("g")).select(*by, "g.*")
    out = grid.join(counted, list(by) + ["bin_index"], "left")
    return out.select(*by, "bin_index", "bin",
                      F.coalesce("count_positive", F.lit(0)).cast("long").alias("count_positive"),
                      F.coalesce("count_negative", F.lit(0)).cast("long").alias("count_negative"))


def eval_separation_quality(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of positives in bins centred above 0.5, with the reference's verdict."""
    agg = hist.groupBy(*by).agg(
        F.sum(F.when(F.col("bin") > 0.5, F.col("count_positive")).otherwise(0)).alias("pos_above"),
        F.sum("count_positive").alias("pos_total"))
    q = _safe_div(F.col("pos_above"), F.col("pos_total"))
    verdict = F.when(q > SEPARATION_BANDS[0][0], SEPARATION_BANDS[0][1]) \
        .when(q > SEPARATION_BANDS[1][0], SEPARATION_BANDS[1][1]).otherwise(SEPARATION_WORST)
    return agg.select(*by, q.alias("separation"), verdict.alias("verdict"))


def eval_calibration(scored: DataFrame, n_bins: int = 10, by: list[str] = (),
                     score: str = "probability") -> DataFrame:
    """Reliability curve over uniform bins; an edge value belongs to the lower bin; empty bins dropped."""
    edges = uniform_edges(n_bins)
    b = count_below(F.col(score).cast("double"), edges[1:-1], strict=True)
    return scored.groupBy(*by, b.alias("bin_index")).agg(
        F.avg(F.col(score).cast("double")).alias("mean_predicted"),
        F.avg((F.col("label") == 1.0).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("n"))


def eval_calibration_error(calib: DataFrame, by: list[str] = ()) -> DataFrame:
    agg = calib.groupBy(*by).agg(
        F.avg(F.abs(F.col("mean_predicted") - F.col("fraction_positive"))).alias("calibration_error"))
    e = F.col("calibration_error")
    verdict = F.when(e < CALIBRATION_BANDS[0][0], CALIBRATION_BANDS[0][1]) \
        .when(e < CALIBRATION_BANDS[1][0], CALIBRATION_BANDS[1][1]).otherwise(CALIBRATION_WORST)
    return agg.select(*by, "calibration_error", verdict.alias("verdict"))


def _curve_base(scored: DataFrame, by: list[str], score: str) -> DataFrame:
    """Distinct scores with cumulative positives/negatives at or above each score.

    The running sums are bucketed by score, within the group if there is one, so a curve over
    continuous scores of a single model still runs in many tasks.
    """
    sc = score_counts(scored, by, score).withColumn("__neg_score", -F.col("score"))
    cum = cumulative_sum(sc, "__neg_score", ["pos", "neg"], partition_cols=by).drop("__neg_score")
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return attach(cum, tot, list(by))


def _with_start(base: DataFrame, by: list[str], point: dict, start: dict) -> DataFrame:
    """The curve's points and, beside that of the highest score, its start (score null)."""
    here = F.struct(F.col("score").cast("double").alias("score"), *[v.alias(k) for k, v in point.items()])
    first = F.struct(F.lit(None).cast("double").alias("score"), *[F.lit(v).alias(k) for k, v in start.items()])
    highest = (F.col("pos_cum") == F.col("pos")) & (F.col("neg_cum") == F.col("neg"))
    both = base.select(*by, F.explode(F.when(highest, F.array(here, first)).otherwise(F.array(here))).alias("__p"))
    return both.select(*by, "__p.*")


def eval_roc_curve(scored: DataFrame, by: list[str] = (), score: str = "probability") -> DataFrame:
    """One (fpr, tpr) point per distinct score, descending, plus the (0, 0) start."""
    by = list(by)
    point = {"fpr": _safe_div(F.col("neg_cum"), F.col("N")), "tpr": _safe_div(F.col("pos_cum"), F.col("P"))}
    return _with_start(_curve_base(scored, by, score), by, point, {"fpr": 0.0, "tpr": 0.0})


def eval_pr_curve(scored: DataFrame, by: list[str] = (), score: str = "probability") -> DataFrame:
    """(recall, precision) per distinct score threshold plus the (0, 1) end point."""
    by = list(by)
    point = {"recall": _safe_div(F.col("pos_cum"), F.col("P")),
             "precision": _safe_div(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum"))}
    return _with_start(_curve_base(scored, by, score), by, point, {"recall": 0.0, "precision": 1.0})


def eval_pr_auc(scored: DataFrame, by: list[str] = (), score: str = "probability") -> DataFrame:
    """Trapezoid rule over the PR curve ordered by score (as the client computes it).

    A point's neighbour at the next higher score is its own running sums without its own counts,
    so no window over the curve is needed; the neighbour of the highest score is the (0, 1) end.
    """
    base = _curve_base(scored, list(by), score)
    pos, neg = F.col("pos_cum") - F.col("pos"), F.col("neg_cum") - F.col("neg")
    recall, recall0 = _safe_div(F.col("pos_cum"), F.col("P")), _safe_div(pos, F.col("P"))
    precision = _safe_div(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum"))
    precision0 = F.when(pos + neg > 0, pos / (pos + neg)).otherwise(1.0)
    area = F.abs(recall - recall0) * (precision + precision0) / 2
    return base.groupBy(*by).agg(F.abs(F.coalesce(F.sum(area), F.lit(0.0))).alias("pr_auc"))


def eval_auc_roc(scored: DataFrame, by: list[str] = (), score: str = "probability",
                 positive: float = 1.0) -> DataFrame:
    """Binary AUC by the rank-sum form with average ranks on ties.

    AUC = Σ_s pos(s)·(neg below s + ½·neg at s) / (P·N), over distinct scores.
    """
    sc = score_counts(scored, by, score, positive)
    cum = cumulative_sum(sc, "score", ["neg"], partition_cols=list(by))
    term = F.col("pos") * (F.col("neg_cum") - F.col("neg") + 0.5 * F.col("neg"))
    agg = cum.groupBy(*by).agg(F.sum(term).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("u") / (F.col("P") * F.col("N"))).alias("auc"),
                      F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"))


def eval_auc_ovr(scored_long: DataFrame, by: list[str] = ()) -> DataFrame:
    """Multiclass one-vs-rest AUC from long scores ``(id, label, class, score)``.

    Per class: AUC of ``score`` for ``label == class``; overall: support-weighted mean.
    """
    df = scored_long.select(*by, "class", "score",
                            F.when(F.col("label") == F.col("class"), 1.0).otherwise(0.0).alias("label"))
    per = eval_auc_roc(df, list(by) + ["class"], score="score")
    overall = per.groupBy(*by).agg(
        (F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc_weighted"))
    return attach(per, overall, list(by), "left")


# ---------------------------------------------------------------- regression
def eval_r2_rmse_mae(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    err = F.col("label").cast("double") - F.col("prediction").cast("double")
    agg = scored.groupBy(*by).agg(
        F.sum(err * err).alias("sse"), F.avg(F.abs(err)).alias("mae"), F.count(F.lit(1)).alias("n"),
        F.var_pop(F.col("label").cast("double")).alias("vy"))
    sst = F.col("vy") * F.col("n")
    return agg.select(*by, F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"),
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", "n")


# ---------------------------------------------------------------- comparisons
def erfc(z: Column) -> Column:
    """Complementary error function, rational Chebyshev form (fractional error < 1.2e-7)."""
    # Published coefficients of the erfc approximation (Numerical Recipes, erfcc).
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    za = F.abs(z)
    t = 1.0 / (1.0 + 0.5 * za)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-za * za + poly)
    return F.when(z >= 0, ans).otherwise(2.0 - ans)


def eval_mcnemar(scored: DataFrame, model_a: str, model_b: str, model_col: str = "model") -> DataFrame:
    """Continuity-corrected McNemar test between two models on the same ids (inner join)."""
    a = scored.where(F.col(model_col) == model_a).select("id", "label", F.col("prediction").alias("pa"))
    b = scored.where(F.col(model_col) == model_b).select("id", F.col("prediction").alias("pb"))
    j = a.join(b, "id")
    ra, rb = F.col("pa") == F.col("label"), F.col("pb") == F.col("label")
    agg = j.agg(F.sum((ra & ~rb).cast("long")).alias("ab"), F.sum((~ra & rb).cast("long")).alias("ba"))
    n = F.col("ab") + F.col("ba")
    stat = F.when(n > 0, F.pow(F.abs(F.col("ab") - F.col("ba")) - 1, 2) / n).otherwise(F.lit(0.0))
    out = agg.select(F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"),
                     F.coalesce("ab", F.lit(0)).cast("long").alias("ab"),
                     F.coalesce("ba", F.lit(0)).cast("long").alias("ba"), stat.alias("statistic"))
    p = F.when(F.col("ab") + F.col("ba") > 0, erfc(F.sqrt(F.col("statistic") / 2))).otherwise(F.lit(1.0))
    return out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


def eval_leaderboard(candidates: DataFrame, score_col: str = "cv_score",
                     train_col: str = "train_score") -> DataFrame:
    """Rank by score: champion, challengers (ranks 2-3), dropped; overfit when train − CV > 0.10."""
    w = Window.orderBy(F.desc(score_col), F.asc("model_name"))
    r = F.row_number().over(w)
    gap = F.coalesce(F.col(train_col), F.lit(0.0)) - F.coalesce(F.col(score_col), F.lit(0.0))
    return candidates.select("*", r.cast("long").alias("rank")).select(
        "*", F.when(F.col("rank") == 1, "champion").when(F.col("rank") <= 3, "challenger")
        .otherwise("dropped").alias("status"),
        (gap > OVERFIT_GAP).alias("overfit"), gap.alias("overfit_gap"))


def eval_business_impact(counts: DataFrame, tp_benefit: float = 100.0, fp_cost: float = 10.0,
                         fn_cost: float = 50.0, tn_benefit: float = 0.0) -> DataFrame:
    """Net value of a confusion (tp, fp, fn, tn), a prevalence-matched random baseline, lift %."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    net = tp * tp_benefit - fp * fp_cost - fn * fn_cost + tn * tn_benefit
    total = tp + fp + fn + tn
    pf = (tp + fn) / F.greatest(total, F.lit(1.0))
    rnd = (total * pf * pf * tp_benefit - total * (1 - pf) * pf * fp_cost
           - total * pf * (1 - pf) * fn_cost + total * (1 - pf) * (1 - pf) * tn_benefit)
    lift = F.when(rnd != 0, (net - rnd) / F.abs(rnd) * 100).otherwise(F.lit(0.0))
    return counts.select("*", net.alias("net_impact"), rnd.alias("random_impact"), lift.alias("lift_pct"))


def cv_fold_summary(scored: DataFrame, by: list[str] = ("model",), fold_col: str = "fold") -> DataFrame:
    """Per-fold accuracy, then mean, population std, min and max across folds."""
    per = eval_accuracy(scored, list(by) + [fold_col])
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), F.avg("accuracy").alias("mean"),
                                F.stddev_pop("accuracy").alias("std"), F.min("accuracy").alias("min"),
                                F.max("accuracy").alias("max"))
