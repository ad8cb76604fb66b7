"""Exploratory analysis (survey §2.5): issues, correlations, target view, MI.

Correlations come from the co-moments of all pairs, taken by matrix products in one scan
(``comoments``).  Mutual information is a plug-in estimate on quantile bins: one pass for bin edges
(bounded: 9 numbers per feature), then each task counts (feature, x-bin, y-bin) cells of its rows in
tables, so what leaves the scan is bounded by tasks times cells, whatever the row count.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import column_quantiles, nan_to_null, numeric_columns, q
from .comoments import comoments

CELLS = 200_000  # cells a task holds before it sends them

# Thresholds of the reference analyzer.
MAR_BELOW = 0.1
MNAR_ABOVE = 0.5
ISSUE_MISSING = 0.3
ISSUE_MISSING_HIGH = 0.5
DUP_MEDIUM = 0.02
HIGH_CORR = 0.9
TARGET_TOP = 20        # rows of the target report
IMBALANCE_MAX_CLASSES = 20
IMBALANCE_MEDIUM = 3
IMBALANCE_HIGH = 10
MI_BINS = 10
DISCRETE_MAX = 20

ISSUE_SCHEMA = ("type string, severity string, column_name string, title string, detail string, "
                "phase string, metric double, affected_columns array<string>")


def _issue(type_: str, severity: Column, column: Column, title: Column, detail: Column,
           phase: str, metric: Column, affected: Column) -> list[Column]:
    return [F.lit(type_).alias("type"), severity.alias("severity"), column.cast("string").alias("column_name"),
            title.alias("title"), detail.alias("detail"), F.lit(phase).alias("phase"),
            metric.cast("double").alias("metric"), affected.alias("affected_columns")]


def eda_missingness(profile_cols: DataFrame) -> DataFrame:
    mp = F.col("missing_pct")
    return profile_cols.where(mp > 0).select(
        "column_name", F.round(mp * F.col("n_rows")).cast("long").alias("missing_count"),
        F.round(mp, 4).alias("missing_pct"),
        F.when(mp < MAR_BELOW, "MAR").when(mp > MNAR_ABOVE, "MNAR").otherwise("unknown").alias("pattern"))


def eda_issue_missing(profile_cols: DataFrame) -> DataFrame:
    mp = F.col("missing_pct")
    name = F.col("column_name")
    return profile_cols.where(mp > ISSUE_MISSING).select(*_issue(
        "missing_values", F.when(mp > ISSUE_MISSING_HIGH, "high").otherwise("medium"), name,
        F.concat(F.lit("High missing rate: "), name),
        F.format_string("%.1f%% of values missing in %s", mp * 100, name),
        "cleaning", F.round(mp, 4), F.array(name)))


def eda_issue_duplicates(profile_ds: DataFrame) -> DataFrame:
    dup = F.col("duplicate_rows")
    share = dup / F.greatest(F.col("row_count"), F.lit(1))
    return profile_ds.where(dup > 0).select(*_issue(
        "duplicates", F.when(share > DUP_MEDIUM, "medium").otherwise("low"), F.lit(None),
        F.concat(dup.cast("string"), F.lit(" duplicate rows detected")),
        F.format_string("Dataset contains %d duplicate rows (%.1f%% of data)", dup, share * 100),
        "cleaning", F.round(share, 4), F.array().cast("array<string>")))


def eda_correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form (col_a, col_b, r) over all numeric columns (or those given).

    Pearson, pairwise-complete, from the co-moments of one scan; a null or undefined r is reported as
    0 (so is one with an infinite value); the diagonal is 1 for a non-constant column.  Both (a, b)
    and (b, a) rows.
    """
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "col_a string, col_b string, r double")
    shape = F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))
    r = F.when((F.col("aa") > 0) & (F.col("bb") > 0) & ~F.isnan("ab"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shape)))
    pairs = comoments(df, cols).select("a", "b", F.when(F.col("a") == F.col("b"), (r.isNotNull()).cast("double"))
                                       .otherwise(F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))).alias("r"))
    # the pairs cover all columns, also where the table has no row
    names = F.array(*[F.lit(c) for c in cols])
    grid = spark.range(len(cols)).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(len(cols) - 1))).alias("b"))
    pairs = grid.join(pairs, ["a", "b"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = pairs.select(F.explode(ends).alias("e"), "r")
    return both.select(F.get(names, F.col("e.a")).alias("col_a"), F.get(names, F.col("e.b")).alias("col_b"), "r")


def eda_high_correlation(corr_long: DataFrame, columns: list[str], threshold: float = HIGH_CORR) -> DataFrame:
    """Pairs i < j (in column order) with |r| above the threshold."""
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return corr_long.where((order[F.col("col_a")] < order[F.col("col_b")]) &
                           (F.abs("r") > threshold)).select("col_a", "col_b", "r")


def eda_issue_correlation(high: DataFrame) -> DataFrame:
    agg = high.agg(F.count(F.lit(1)).alias("n"),
                   F.array_sort(F.collect_set("col_a")).alias("cols"))
    return agg.where(F.col("n") > 0).select(*_issue(
        "correlation", F.lit("high"), F.lit(None),
        F.format_string("High correlation between %d feature pair(s)", F.col("n")),
        F.lit("Highly correlated features may cause multicollinearity. Consider dropping one."),
        "features", F.lit(HIGH_CORR), F.col("cols")))


def eda_target_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows of every (non-null) target value."""
    return (df.where(F.col(q(target)).isNotNull())
            .groupBy(F.col(q(target)).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count")))


def eda_target_distribution(df: DataFrame, target: str, top: int = TARGET_TOP) -> DataFrame:
    """Report of the most frequent target values (non-null), ties by label."""
    return eda_target_counts(df, target).orderBy(F.desc("count"), F.asc("label")).limit(top)


def eda_issue_imbalance(target_counts: DataFrame, target: str) -> DataFrame:
    """``target_counts`` holds every class (``eda_target_counts``), not a report of the largest."""
    agg = target_counts.agg(F.count(F.lit(1)).alias("k"), F.max("count").alias("mx"), F.min("count").alias("mn"))
    ratio = F.col("mx") / F.greatest(F.col("mn"), F.lit(1))
    return agg.where((F.col("k") >= 2) & (F.col("k") <= IMBALANCE_MAX_CLASSES) & (ratio > IMBALANCE_MEDIUM)).select(*_issue(
        "class_imbalance", F.when(ratio > IMBALANCE_HIGH, "high").otherwise("medium"), F.lit(target),
        F.lit(f"Class imbalance detected in '{target}'"),
        F.format_string("Majority class is %.1fx larger than minority class. Consider SMOTE or class weighting.", ratio),
        "sampling", F.round(ratio, 2), F.array(F.lit(target))))


def eda_issue_low_variance(profile_cols: DataFrame) -> DataFrame:
    name = F.col("column_name")
    return profile_cols.where((F.col("inferred_type") == "numeric") &
                              F.array_contains("warnings", "Near-zero variance")).select(*_issue(
        "low_variance", F.lit("low"), name, F.concat(F.lit("Near-zero variance: "), name),
        F.format_string("Column '%s' has near-constant values — low predictive power.", name),
        "features", F.lit(0.0), F.array(name)))


def eda_issues(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ------------------------------------------------------------------ mutual information
def _bin_plan(df: DataFrame, cols: list[str], bins: int, discrete_max: int, approx: bool | None):
    """Per column: median, quantile edges, and whether it is treated as discrete (a few numbers)."""
    probs = [i / bins for i in range(1, bins)]
    allp = [0.5] + probs
    aggs = [F.approx_count_distinct(F.col(q(c)).cast("double")).alias(f"d{i}") for i, c in enumerate(cols)]
    if approx:
        aggs += [F.percentile_approx(F.col(q(c)).cast("double"), allp, 100000).alias(f"q{i}") for i, c in enumerate(cols)]
    dist = df.agg(*aggs).first()
    if approx:
        qs = {(c, float(p)): (dist[f"q{i}"] or [None] * len(allp))[j] for i, c in enumerate(cols) for j, p in enumerate(allp)}
    else:
        qs = column_quantiles(df, cols, allp)
    plan = {}
    for i, c in enumerate(cols):
        plan[c] = dict(median=qs[(c, 0.5)], edges=[float(qs[(c, float(p))]) for p in probs if qs[(c, float(p))] is not None],
                       discrete=(dist[f"d{i}"] or 0) <= discrete_max)
    return plan


def _binned(x: np.ndarray, spec: dict) -> np.ndarray:
    """Values of a discrete column, numbers of edges below the value of any other; missing is the median."""
    x = np.where(np.isnan(x), np.nan if spec["median"] is None else spec["median"], x)
    return x if spec["discrete"] else np.searchsorted(np.array(spec["edges"], float), x, "left").astype(float)


def _cells(features: list[str], plan: dict, target: dict | None):
    """Counts of (feature, x, y) of a task's rows; the last column is the target."""
    def count(batches):
        held: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(batch.num_columns - 1)
            if target is None:
                coded = last.dictionary_encode()
                names, y = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            else:
                values, y = np.unique(_binned(last.to_numpy(zero_copy_only=False).astype(float), target), return_inverse=True)
                names = [repr(float(v)) for v in values]
            for i, f in enumerate(features):
                x, at = np.unique(_binned(batch.column(i).to_numpy(zero_copy_only=False).astype(float), plan[f]), return_inverse=True)
                both, many = np.unique(at * len(names) + y, return_counts=True)
                for cell, n in zip(both.tolist(), many.tolist(), strict=True):
                    key = (i, float(x[cell // len(names)]), names[cell % len(names)])
                    held[key] = held.get(key, 0) + n
            if len(held) > CELLS:
                yield _sent(held, features)
                held = {}
        if held:
            yield _sent(held, features)

    return count


def _sent(held: dict, features: list[str]) -> pa.RecordBatch:
    feature, x, y = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([features[i] for i in feature]), pa.array(x, pa.float64()), pa.array(y, pa.string()), pa.array(list(held.values()), pa.int64())],
        ["feature", "x", "y", "n"])


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = MI_BINS,
                       discrete_max: int = DISCRETE_MAX, approx: bool | None = None) -> DataFrame:
    """(feature, mi) in nats: plug-in MI between binned feature and (binned) target.

    Features are median-imputed; a feature or target with at most
    ``discrete_max`` distinct values is used as is, otherwise cut at its
    ``bins``-quantiles.  Rows with a null target are dropped.
    """
    df = nan_to_null(df).where(F.col(q(target)).isNotNull())
    tfield = df.schema[target].dataType
    numeric_target = not isinstance(tfield, (T.StringType, T.BooleanType))
    plan = _bin_plan(df, features + ([target] if numeric_target else []), bins, discrete_max, approx)
    y = F.col(q(target)).cast("double" if numeric_target else "string")
    rows = df.select(*[F.col(q(f)).cast("double").alias(f"c{i}") for i, f in enumerate(features)], y.alias("y"))
    cells = rows.mapInArrow(_cells(features, plan, plan[target] if numeric_target else None), "feature string, x double, y string, n long")
    nxy = cells.groupBy("feature", "x", "y").agg(F.sum("n").alias("nxy"))
    wx, wy, wf = (Window.partitionBy("feature", "x"), Window.partitionBy("feature", "y"),
                  Window.partitionBy("feature"))
    t = nxy.select("feature", "nxy", F.sum("nxy").over(wx).alias("nx"), F.sum("nxy").over(wy).alias("ny"),
                   F.sum("nxy").over(wf).alias("n"))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return t.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def eda_mutual_information(df: DataFrame, target: str, **kw) -> DataFrame:
    """Every numeric feature with its mutual information, most informative first."""
    feats = [c for c in numeric_columns(df) if c != target]
    return mutual_information(df, feats, target, **kw).orderBy(F.desc("mi"), F.asc("feature"))


def eda_abs_correlation_rank(df: DataFrame, target: str) -> DataFrame:
    """|corr(feature, target)| for numeric features, descending (fallback ranking)."""
    df = nan_to_null(df)
    feats = [c for c in numeric_columns(df) if c != target]
    wide = df.agg(*[F.corr(F.col(q(f)).cast("double"), F.col(q(target)).cast("double")).alias(f"c{i}")
                    for i, f in enumerate(feats)])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 F.abs(F.coalesce(F.when(~F.isnan(F.col(f"c{i}")), F.col(f"c{i}")), F.lit(0.0))).alias("score"))
        for i, f in enumerate(feats)])).alias("s")).select("s.*")
    return long


def eda_feature_overrides(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Attach a user decision (auto / include / exclude) per feature; default auto."""
    return (scores.join(F.broadcast(overrides), "feature", "left")
            .withColumn("override", F.coalesce(F.col("override"), F.lit("auto"))))
