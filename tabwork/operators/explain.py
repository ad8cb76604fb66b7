"""Explanations (survey §2.12).

Models are Spark ML transformers that read feature columns and write
``prediction`` (a fitted ``PipelineModel`` with its assembler, or any
transformer).  Every explainer builds the perturbed rows with explodes of
small literal arrays (coalitions, grid points) and scores them in one
``transform`` — no per-row Python and no cartesian joins.
"""
from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import column_quantiles, q

PDP_POINTS = 30
BOUND_ROWS = 200_000   # rows from which the bounds of the quantiles of predictions are taken
BOUND_MARGIN = 0.004   # share of rows on either side: six standard errors of a decile of so many, and their accuracy


def explain_linear_shap(df: DataFrame, coefs: dict[str, float], means: dict[str, float], id_col: str) -> DataFrame:
    """Exact contributions of a linear model: φ_f = coef_f · (x_f − mean_f), long form."""
    feats = list(coefs)
    return df.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 (F.lit(float(coefs[f])) * (F.col(q(f)).cast("double") - F.lit(float(means[f])))).alias("contribution"))
        for f in feats])).alias("s")).select(id_col, "s.*")


def explain_global_rank(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution")) \
        .orderBy(F.desc("mean_abs_contribution"), F.asc("feature"))


def explain_waterfall(contrib: DataFrame, id_col: str, row_id) -> DataFrame:
    """One row's contributions, largest magnitude first (with rank)."""
    one = contrib.where(F.col(id_col) == F.lit(row_id))
    w = Window.orderBy(F.desc(F.abs("contribution")), F.asc("feature"))  # d rows
    return one.select("*", F.row_number().over(w).cast("long").alias("rank"))


def explain_sampled_shapley(model, df: DataFrame, features: list[str], id_col: str,
                            n_permutations: int = 8, seed: int = 42) -> DataFrame:
    """Permutation-sampling Shapley values (Štrumbelj & Kononenko 2014).

    The reference point is the feature means.  For each row, each sampled
    permutation and each prefix length j, features in the prefix take the
    row's value and the rest the reference; consecutive predictions differ by
    the contribution of the feature added at j, so contributions sum to
    f(x) − f(reference) exactly.  All coalitions are scored in one transform.
    """
    d = len(features)
    rng = random.Random(seed)
    perms = [rng.sample(range(d), d) for _ in range(n_permutations)]
    ref = df.agg(*[F.avg(F.col(q(f)).cast("double")).alias(f) for f in features]).first()
    # a prediction counts for the feature that its step added, and against the one added next
    steps = []
    for perm in perms:
        for j in range(d + 1):
            before = set(perm[:j])
            signed = [F.struct(F.lit(features[perm[j - 1]]).alias("feature"), F.lit(1.0).alias("sign"))] if j else []
            if j < d:
                signed.append(F.struct(F.lit(features[perm[j]]).alias("feature"), F.lit(-1.0).alias("sign")))
            steps.append(F.struct(F.array(*[F.lit(int(i in before)) for i in range(d)]).alias("mask"),
                                  F.array(*signed).alias("signed")))
    ex = df.select(id_col, *[F.col(q(f)) for f in features], F.explode(F.array(*steps)).alias("s"))
    coal = ex.select(id_col, "s.signed", *[
        F.when(F.col("s.mask")[i] == 1, F.col(q(f)).cast("double")).otherwise(F.lit(float(ref[f]))).alias(f)
        for i, f in enumerate(features)])
    scored = model.transform(coal).select(id_col, F.col("prediction").cast("double"), F.explode("signed").alias("t"))
    return scored.groupBy(id_col, F.col("t.feature").alias("feature")).agg(
        (F.sum(F.col("prediction") * F.col("t.sign")) / n_permutations).alias("contribution"))


def explain_base_value(model, df: DataFrame, features: list[str]) -> float:
    ref = df.agg(*[F.avg(F.col(q(f)).cast("double")).alias(f) for f in features])
    return float(model.transform(ref).first()["prediction"])


def explain_pdp(model, df: DataFrame, feature: str, n_points: int = PDP_POINTS) -> DataFrame:
    """Partial dependence: ``n_points`` values between the 1st and 99th percentile;
    mean, p10 and p90 of predictions with the feature set to each value (all rows)."""
    qs = column_quantiles(df, [feature], [0.01, 0.99])
    lo, hi = float(qs[(feature, 0.01)]), float(qs[(feature, 0.99)])
    grid = [lo + (hi - lo) * i / (n_points - 1) for i in range(n_points)] if n_points > 1 else [lo]
    from ..functions.quantiles import means_and_quantiles, quantile_bounds_wide
    keys, probs = ["point", "grid_value"], [0.1, 0.9]
    names = [f"b{i}" for i in range(2 * len(probs))]

    def scored(rows: DataFrame, bounds: dict) -> DataFrame:
        none = [None] * len(names)
        g = F.array(*[F.struct(F.lit(i).cast("long").alias("point"), F.lit(v).alias("value"),
                               *[F.lit(b).cast("double").alias(n) for n, b in zip(names, bounds.get(i) or none)])
                      for i, v in enumerate(grid)])
        ex = rows.select("*", F.explode(g).alias("__g")).withColumn(feature, F.col("__g.value"))
        return model.transform(ex).select(F.col("__g.point").alias("point"), F.col("__g.value").alias("grid_value"),
                                          *[F.col(f"__g.{n}").alias(n) for n in names], F.col("prediction").cast("double"))

    # a sample only tells near which values the quantiles lie; if one lies elsewhere, the exact plan runs over all
    n = df.count()
    some = df if n <= BOUND_ROWS else df.sample(BOUND_ROWS / n, seed=42)
    near = scored(some, {}).groupBy("point").agg(quantile_bounds_wide("prediction", probs, BOUND_MARGIN).alias("b"))
    bounds = {r["point"]: r["b"] for r in near.collect()}  # four numbers per grid point
    ends = [(F.col(names[2 * i]), F.col(names[2 * i + 1])) for i in range(len(probs))]
    means, qs = means_and_quantiles(scored(df, bounds), keys, "prediction", probs, ends)
    bands = qs.groupBy(*keys).agg(F.max(F.when(F.col("p") == 0.1, F.col("value"))).alias("p10"),
                                  F.max(F.when(F.col("p") == 0.9, F.col("value"))).alias("p90"))
    return (means.join(bands, keys)
            .select("point", F.col("grid_value").alias("value"), "mean", "p10", "p90"))


def explain_pdp_features(importances: DataFrame) -> DataFrame:
    """All features with a positive importance, most important first."""
    return (importances.where(F.col("importance") > 0).orderBy(F.desc("importance"), F.asc("feature"))
            .select("feature", "importance"))


def explain_counterfactual(model, df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """Every row with its numeric features set to the medians: new prediction and the
    range-normalised Euclidean distance to the original row (fitted encodings reused, Q19)."""
    med = column_quantiles(df, features, [0.5])
    st = df.agg(*[F.min(F.col(q(f)).cast("double")).alias(f"lo_{f}") for f in features],
                *[F.max(F.col(q(f)).cast("double")).alias(f"hi_{f}") for f in features]).first().asDict()
    st.update({f"m_{f}": med[(f, 0.5)] for f in features})
    # both predictions from the same row: the originals ride along while the medians are scored
    own = [f"__own_{i}" for i in range(len(features))]
    base = model.transform(df).select(id_col, F.col("prediction").alias("original_prediction"),
                                      *[F.col(q(f)).alias(o) for f, o in zip(features, own)])
    cf = base.withColumns({f: F.lit(float(st[f"m_{f}"])) for f in features})
    dist = F.sqrt(sum(((F.col(o).cast("double") - F.lit(float(st[f"m_{f}"]))) /
                       F.lit(float((st[f"hi_{f}"] - st[f"lo_{f}"]) or 1.0))) ** 2 for f, o in zip(features, own)))
    return model.transform(cf).select(id_col, "original_prediction",
                                      F.col("prediction").alias("counterfactual_prediction"), dist.alias("distance"))


def explain_unsupervised_clusters(centers: list[list[float]], features: list[str]) -> list[tuple[str, float]]:
    """Feature importance of a clustering: spread of the cluster centres per feature, normalised
    (the centres are the fitted model, k × d numbers)."""
    import numpy as np
    c = np.asarray(centers, dtype=float)
    v = c.var(axis=0)
    tot = float(v.sum()) or 1.0
    return sorted(((f, float(x) / tot) for f, x in zip(features, v)), key=lambda t: (-t[1], t[0]))
