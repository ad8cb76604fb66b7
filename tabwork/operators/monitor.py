"""Monitoring, drift and active learning over a prediction log (survey §2.13).

Log schema: ``id, prediction_id, deployment_id, created_at, input_features
map<string,string>, probabilities array<double>, confidence double,
ground_truth string (JSON or plain)``.  Features are compared in long form
``(feature, value)`` so any number of features is one aggregate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import cumulative_sum
from ..functions.quantiles import quantiles_long

# PSI bucket count and epsilon, drift bands, uncertainty epsilon.
PSI_BUCKETS = 10
PSI_EPS = 1e-6
DRIFT_STABLE = 0.1
DRIFT_WARNING = 0.25
ENTROPY_EPS = 1e-12
UNCERTAIN_MAX_N = 500


def drift_level(psi: Column) -> Column:
    return F.when(psi < DRIFT_STABLE, "stable").when(psi < DRIFT_WARNING, "warning").otherwise("critical")


def features_long(log: DataFrame, features: list[str] | None = None, map_col: str = "input_features") -> DataFrame:
    """(feature, value string) rows from the feature map (all keys or the given ones)."""
    ex = log.select(F.explode(F.col(map_col)).alias("feature", "value"))
    return ex.where(F.col("feature").isin(features)) if features else ex


def psi_numeric(baseline: DataFrame, current: DataFrame, buckets: int = PSI_BUCKETS) -> DataFrame:
    """PSI per feature from long frames ``(feature, value double)``.

    Equal-width buckets over the joint min-max; bucket shares (count + eps) / n
    per side; Σ (c − b)·ln(c / b).  A feature with no spread scores 0.
    """
    both = (baseline.select("feature", F.col("value").cast("double").alias("v"), F.lit("b").alias("side"))
            .unionByName(current.select("feature", F.col("value").cast("double").alias("v"), F.lit("c").alias("side")))
            .where(F.col("v").isNotNull()))
    rng = both.groupBy("feature").agg(F.min("v").alias("mn"), F.max("v").alias("mx"),
                                      F.sum((F.col("side") == "b").cast("long")).alias("nb"),
                                      F.sum((F.col("side") == "c").cast("long")).alias("nc"))
    step = (F.col("mx") - F.col("mn")) / buckets
    idx = F.least(F.floor((F.col("v") - F.col("mn")) / step).cast("long"), F.lit(buckets - 1))
    counted = (both.join(F.broadcast(rng), "feature").where(F.col("mx") > F.col("mn"))
               .groupBy("feature", idx.alias("bucket"))
               .agg(F.sum((F.col("side") == "b").cast("long")).alias("cb"),
                    F.sum((F.col("side") == "c").cast("long")).alias("cc")))
    grid = rng.select("feature", "mn", "mx", "nb", "nc",
                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    j = grid.join(counted, ["feature", "bucket"], "left")
    b = (F.coalesce("cb", F.lit(0)) + PSI_EPS) / F.col("nb")
    c = (F.coalesce("cc", F.lit(0)) + PSI_EPS) / F.col("nc")
    term = F.when((F.col("mx") > F.col("mn")) & (F.col("nb") > 0) & (F.col("nc") > 0), (c - b) * F.log(c / b))
    return j.groupBy("feature").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("psi"))


def psi_categorical(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """PSI per feature over the union of categories (full outer join of frequency tables)."""
    fb = baseline.groupBy("feature", F.col("value").cast("string").alias("cat")).agg(F.count(F.lit(1)).alias("cb"))
    fc = current.groupBy("feature", F.col("value").cast("string").alias("cat")).agg(F.count(F.lit(1)).alias("cc"))
    j = fb.join(fc, ["feature", "cat"], "full_outer")
    w = Window.partitionBy("feature")
    t = j.select("feature", F.coalesce("cb", F.lit(0)).alias("cb"), F.coalesce("cc", F.lit(0)).alias("cc"),
                 F.sum(F.coalesce("cb", F.lit(0))).over(w).alias("nb"),
                 F.sum(F.coalesce("cc", F.lit(0))).over(w).alias("nc"))
    b = (F.col("cb") + PSI_EPS) / F.greatest(F.col("nb"), F.lit(1))
    c = (F.col("cc") + PSI_EPS) / F.greatest(F.col("nc"), F.lit(1))
    return t.groupBy("feature").agg(F.sum((c - b) * F.log(c / b)).alias("psi"))


def drift_ks(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Two-sample KS statistic per feature: max |F_b(x) − F_c(x)| over the pooled values.

    Values are reduced to distinct (feature, value) counts first; running
    shares use the bucketed grouped running sum (no per-feature single task).
    """
    both = (baseline.select("feature", F.col("value").cast("double").alias("v"), F.lit(1).alias("ib"))
            .unionByName(current.select("feature", F.col("value").cast("double").alias("v"), F.lit(0).alias("ib")))
            .where(F.col("v").isNotNull()))
    cnt = both.groupBy("feature", "v").agg(F.sum("ib").cast("long").alias("nb"),
                                           F.sum(1 - F.col("ib")).cast("long").alias("nc"))
    tot = cnt.groupBy("feature").agg(F.sum("nb").alias("tb"), F.sum("nc").alias("tc"))
    cum = cumulative_sum(cnt, "v", ["nb", "nc"], partition_cols=["feature"])
    d = F.abs(F.col("nb_cum") / F.col("tb") - F.col("nc_cum") / F.col("tc"))
    return (cum.join(F.broadcast(tot), "feature").where((F.col("tb") > 0) & (F.col("tc") > 0))
            .groupBy("feature").agg(F.max(d).alias("ks"), F.first("tb").alias("n_baseline"),
                                    F.first("tc").alias("n_current")))


def latest_n_predictions(log: DataFrame, n: int, deployment_id: str | None = None) -> DataFrame:
    """Newest ``n`` log rows (of one deployment), ties by id: a top-k, not a sort."""
    src = log.where(F.col("deployment_id") == deployment_id) if deployment_id else log
    return src.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def drift_report(baseline: DataFrame, log: DataFrame, numeric: list[str], categorical: list[str],
                 n: int = 500, deployment_id: str | None = None) -> DataFrame:
    """PSI and level per feature for the newest ``n`` logs against a baseline table
    (long form ``(feature, value)``), plus the mean PSI over features."""
    cur = features_long(latest_n_predictions(log, n, deployment_id), numeric + categorical)
    num = psi_numeric(baseline.where(F.col("feature").isin(numeric)), cur.where(F.col("feature").isin(numeric)))
    cat = psi_categorical(baseline.where(F.col("feature").isin(categorical)),
                          cur.where(F.col("feature").isin(categorical)))
    allp = num.unionByName(cat)
    overall = allp.agg(F.avg("psi").alias("overall_drift"))
    return (allp.withColumn("__k", F.lit(0))
            .join(F.broadcast(overall.withColumn("__k", F.lit(0))), "__k").drop("__k")
            .select("feature", "psi", drift_level(F.col("psi")).alias("drift_level"), "overall_drift"))


# ------------------------------------------------------------------ volume and rates
def monitor_volume(log: DataFrame, hours: int = 12, ts: str = "created_at") -> DataFrame:
    """Predictions per hour for the last ``hours`` hours up to the newest row, gaps as 0.

    The newest time is one aggregate over the time column; only rows of the hours shown are counted,
    so the filter reaches the scan.
    """
    end = F.date_trunc("hour", F.max(ts))
    last = log.agg(end.alias("end"))
    first = log.agg(F.date_format(end - F.expr(f"INTERVAL {hours - 1} HOURS"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    shown = log if first is None else log.where(F.col(ts) >= F.lit(first).cast(log.schema[ts].dataType))
    per_hour = shown.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    grid = last.select(F.explode(F.sequence(F.col("end") - F.expr(f"INTERVAL {hours - 1} HOURS"), F.col("end"),
                                            F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return grid.join(per_hour, "hour", "left").select(
        "hour", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def monitor_rate_quantiles(df: DataFrame, measure: str, ts: str, error_flag: Column,
                           window: str = "1 day") -> DataFrame:
    """Per window: p50/p95/p99 of a measure, rows per minute, error share.

    Quantiles are exact at every size (``functions.quantiles``): no window sits in one buffer.
    """
    minutes = {"1 day": 1440.0, "1 hour": 60.0}.get(window, 1440.0)
    w = F.window(ts, window).start.alias("window_start")
    base = df.groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.avg(error_flag.cast("double")).alias("error_rate"))
    long = quantiles_long(df.select(w, F.col(measure).alias("__m")), ["window_start"], "__m", [0.5, 0.95, 0.99])
    qs = long.groupBy("window_start").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                            for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    return base.join(qs, "window_start").select("window_start", "p50", "p95", "p99",
                                                (F.col("n") / minutes).alias("per_minute"), "error_rate")


# ------------------------------------------------------------------ uncertainty
def uncertainty_confidence(conf: Column) -> Column:
    return 1.0 - F.coalesce(conf, F.lit(1.0))


def uncertainty_entropy(probs: Column, conf: Column) -> Column:
    """Normalised Shannon entropy; 0 for a single class; falls back to confidence."""
    n = F.size(probs)
    ent = -F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p * F.log(p + ENTROPY_EPS))
    return (F.when(probs.isNull() | (n == 0), uncertainty_confidence(conf))
            .when(n <= 1, F.lit(0.0)).otherwise(ent / F.log(n.cast("double"))))


def uncertainty_margin(probs: Column, conf: Column) -> Column:
    s = F.sort_array(probs, asc=False)
    return F.when(probs.isNotNull() & (F.size(probs) >= 2), 1.0 - (s[0] - s[1])).otherwise(uncertainty_confidence(conf))


def uncertainty_score(strategy: str) -> Column:
    p, c = F.col("probabilities"), F.col("confidence")
    if strategy == "entropy":
        return uncertainty_entropy(p, c)
    if strategy == "margin":
        return uncertainty_margin(p, c)
    if strategy == "confidence":
        return uncertainty_confidence(c)
    raise ValueError(f"unknown strategy {strategy!r}")


def filter_unlabelled(log: DataFrame, deployment_id: str | None = None) -> DataFrame:
    out = log.where(F.col("ground_truth").isNull())
    return out.where(F.col("deployment_id") == deployment_id) if deployment_id else out


def top_k_by_score(df: DataFrame, score: Column, n: int, tie: str = "id") -> DataFrame:
    return df.select("*", score.alias("uncertainty_score")).orderBy(F.desc("uncertainty_score"), F.asc(tie)).limit(n)


def uncertain_samples(log: DataFrame, n: int = 20, strategy: str = "confidence",
                      deployment_id: str | None = None) -> DataFrame:
    """Top ``n`` unlabelled rows by uncertainty over *all* unlabelled rows, plus the total."""
    if not 1 <= n <= UNCERTAIN_MAX_N:
        raise ValueError("n must be in 1..500")
    un = filter_unlabelled(log, deployment_id)
    total = un.agg(F.count(F.lit(1)).alias("total_unlabeled"))
    top = top_k_by_score(un, uncertainty_score(strategy), n)
    return (top.withColumn("__k", F.lit(0)).join(F.broadcast(total.withColumn("__k", F.lit(0))), "__k")
            .drop("__k"))


def label_of(gt: Column) -> Column:
    """The label inside a JSON ground truth ``{"label": ...}``, else the raw value."""
    return F.coalesce(F.get_json_object(gt, "$.label"), gt)


def record_ground_truth(log: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach a label batch ``(prediction_id, ground_truth, recorded_at)`` to the log.

    Newest label per prediction wins; returns (updated log, unmatched label ids).
    """
    newest = labels.groupBy("prediction_id").agg(
        F.max_by("ground_truth", F.struct("recorded_at", "ground_truth")).alias("__gt"))
    updated = (log.join(newest, "prediction_id", "left")
               .withColumn("ground_truth", F.coalesce(F.col("__gt"), F.col("ground_truth"))).drop("__gt"))
    unmatched = newest.join(log.select("prediction_id"), "prediction_id", "left_anti")
    return updated, unmatched


def labelling_stats(log: DataFrame, by: list[str] = ("deployment_id",)) -> DataFrame:
    lab = F.col("ground_truth").isNotNull()
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.sum(lab.cast("long")).alias("labeled"),
        F.sum((~lab).cast("long")).alias("unlabeled"), F.avg("confidence").alias("avg_confidence"),
        (F.sum(lab.cast("long")) / F.count(F.lit(1))).alias("review_rate"))


def labelling_distribution(log: DataFrame, by: list[str] = ("deployment_id",)) -> DataFrame:
    return (log.where(F.col("ground_truth").isNotNull())
            .groupBy(*by, label_of(F.col("ground_truth")).alias("label")).agg(F.count(F.lit(1)).alias("count")))
