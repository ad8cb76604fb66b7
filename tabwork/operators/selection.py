"""Feature selection (survey §2.9): MI ranking, |r| fallback, overrides, leakage."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .eda import mutual_information

# Keep threshold (share of the best score) and leakage threshold.
KEEP_SHARE = 0.01
LEAKAGE = 0.85


def _rank(scores: DataFrame, method: str) -> DataFrame:
    """Normalise by the maximum, rank (ties by name), keep if ≥ 1 % of the best."""
    mx = scores.agg(F.max("score").alias("mx"))
    j = scores.withColumn("__k", F.lit(0)).join(F.broadcast(mx.withColumn("__k", F.lit(0))), "__k").drop("__k")
    imp = F.col("score") / F.when(F.col("mx") > 0, F.col("mx")).otherwise(F.lit(1.0))
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))  # one row per feature: small
    return (j.select("feature", imp.alias("importance"))
            .select("feature", "importance", F.row_number().over(w).cast("long").alias("rank"),
                    F.lit(method).alias("method"), (F.col("importance") >= KEEP_SHARE).alias("keep")))


def select_mutual_info(encoded: DataFrame, features: list[str], target: str, **kw) -> DataFrame:
    """MI of every (encoded) feature with the target, normalised and ranked."""
    mi = mutual_information(encoded, features, target, **kw).select("feature", F.col("mi").alias("score"))
    return _rank(mi, "mutual_info")


def select_pearson_abs(encoded: DataFrame, features: list[str], target: str) -> DataFrame:
    wide = encoded.agg(*[F.corr(F.col(q(f)).cast("double"), F.col(q(target)).cast("double")).alias(f"c{i}")
                         for i, f in enumerate(features)])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 F.abs(F.coalesce(F.when(~F.isnan(F.col(f"c{i}")), F.col(f"c{i}")), F.lit(0.0))).alias("score"))
        for i, f in enumerate(features)])).alias("s")).select("s.*")
    return _rank(long, "pearson_abs")


def select_with_overrides(importances: DataFrame, overrides: DataFrame) -> DataFrame:
    """include → keep (pinned), exclude → drop (excluded), else the automatic decision."""
    j = importances.join(F.broadcast(overrides), "feature", "left")
    o = F.col("override")
    return j.select("feature", "importance", "rank", "method",
                    F.when(o == "include", True).when(o == "exclude", False).otherwise(F.col("keep")).alias("keep"),
                    F.when(o == "include", "pinned").when(o == "exclude", "excluded").otherwise("auto").alias("decision"))


def select_audit(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.sum(F.col("keep").cast("long")).alias("kept"), F.sum((~F.col("keep")).cast("long")).alias("dropped"),
        F.sum((F.col("decision") == "pinned").cast("long")).alias("pinned"),
        F.sum((F.col("decision") == "excluded").cast("long")).alias("excluded"),
        F.sum((F.col("decision") == "auto").cast("long")).alias("auto"))


def select_features(df: DataFrame, importances: DataFrame, target: str) -> DataFrame:
    """Keep the columns marked keep (bounded list: one per feature), minus the target."""
    keep = [r["feature"] for r in importances.where(F.col("keep")).select("feature").collect()]
    return df.select(*[F.col(q(c)) for c in df.columns if c in keep and c != target])


def leakage_scan(encoded: DataFrame, features: list[str], target: str, threshold: float = LEAKAGE) -> DataFrame:
    """|corr(feature, target)| above the threshold on the encoded matrix, strongest first."""
    wide = encoded.agg(*[F.corr(F.col(q(f)).cast("double"), F.col(q(target)).cast("double")).alias(f"c{i}")
                         for i, f in enumerate(features)])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"c{i}")).alias("correlation"))
        for i, f in enumerate(features)])).alias("s")).select("s.*")
    return long.where(~F.isnan("correlation") & (F.col("correlation") > threshold))
