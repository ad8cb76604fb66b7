"""Workspace analytics over metadata tables (survey §2.14) and staleness (§2.11).

The reference answers these with one lookup per project (N+1 queries); here
each report is a few aggregates and left joins, so it is one job whatever the
number of projects.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Phases in the reference's order and the report column behind each.
PHASES = ["upload", "pii", "profile", "eda", "cleaning", "sampling", "features", "selection",
          "training", "evaluation", "explain", "deploy", "chat"]
PHASE_SOURCE = {"pii": "pii_report", "profile": "profile_data", "eda": "eda_report",
                "cleaning": "cleaning_plan", "sampling": "sampling_config", "features": "feature_plan",
                "selection": "selection_plan", "training": "training_results",
                "evaluation": "evaluation_results", "explain": "training_results"}


def phase_status(datasets: DataFrame) -> DataFrame:
    """done / pending per phase from which report columns are set."""
    ready = F.col("status") == "ready"
    cols = []
    for p in PHASES:
        if p in ("upload", "chat"):
            cond = ready
        elif p == "deploy":
            cond = F.col("training_results").isNotNull() & F.coalesce(F.col("has_deployments"), F.lit(False))
        else:
            cond = F.col(PHASE_SOURCE[p]).isNotNull()
        cols.append(F.when(cond, "done").otherwise("pending").alias(p))
    return datasets.select("id", *cols)


def project_rollup(projects: DataFrame, datasets: DataFrame, audit: DataFrame) -> DataFrame:
    """Per project: dataset count, last activity, best score of ready datasets and its model."""
    dcount = datasets.groupBy("project_id").agg(F.count(F.lit(1)).alias("dataset_count"))
    last = audit.groupBy("project_id").agg(F.max("created_at").alias("last_activity"))
    best = (datasets.where((F.col("status") == "ready") & F.col("best_cv_score").isNotNull())
            .groupBy("project_id").agg(F.max("best_cv_score").alias("best_cv_score"),
                                       F.max_by("best_model", F.struct("best_cv_score", "best_model"))
                                       .alias("best_model")))
    p = projects.select(F.col("id").alias("project_id"), "name")
    return (p.join(dcount, "project_id", "left").join(last, "project_id", "left").join(best, "project_id", "left")
            .select("project_id", "name", F.coalesce("dataset_count", F.lit(0)).cast("long").alias("dataset_count"),
                    "last_activity", F.round("best_cv_score", 4).alias("best_cv_score"), "best_model"))


def project_detail(datasets: DataFrame) -> DataFrame:
    """Datasets of every project, newest first (rank), with the number of phases done."""
    ph = phase_status(datasets)
    done = sum((F.col(p) == "done").cast("int") for p in PHASES)
    w = Window.partitionBy("project_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return (datasets.select("id", "project_id", "status", "updated_at").join(ph.select("id", done.alias("phases_done")), "id")
            .select("*", F.row_number().over(w).alias("rank")))


def project_activity(audit: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest audit rows of every project (salted two-stage top-k)."""
    from ..functions.ordered import top_k_per_group
    return top_k_per_group(audit, ["project_id"], [F.desc("created_at"), F.desc("id")], n)


def platform_overview(projects: DataFrame, datasets: DataFrame, audit: DataFrame) -> DataFrame:
    p = projects.agg(F.count(F.lit(1)).alias("total_projects"),
                     F.sum((F.col("status") == "active").cast("long")).alias("active_projects"))
    d = datasets.agg(F.count(F.lit(1)).alias("total_datasets"),
                     F.sum((F.col("status") == "ready").cast("long")).alias("ready_datasets"),
                     F.sum(F.col("training_results").isNotNull().cast("long")).alias("models_trained"),
                     F.sum((F.col("training_results").isNotNull() & F.col("has_deployments")).cast("long"))
                     .alias("deployed_models"))
    a = audit.where(F.col("actor") != "system").agg(F.countDistinct("actor").alias("active_users"))
    k = F.lit(0)
    return (p.withColumn("__k", k).join(d.withColumn("__k", k), "__k").join(a.withColumn("__k", k), "__k")
            .drop("__k"))


def activity_feed(audit: DataFrame, limit: int = 50, project_id=None) -> DataFrame:
    """The newest ``limit`` entries."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    src = audit.where(F.col("project_id") == project_id) if project_id is not None else audit
    return src.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def run_history(runs: DataFrame, schedule_id=None, dataset_id=None) -> DataFrame:
    """Runs of a schedule and/or dataset, newest first (a distributed sort)."""
    src = runs
    if schedule_id is not None:
        src = src.where(F.col("schedule_id") == schedule_id)
    if dataset_id is not None:
        src = src.where(F.col("dataset_id") == dataset_id)
    return src.orderBy(F.desc("started_at"), F.desc("id"))


def current_production(promotions: DataFrame) -> DataFrame:
    """State from an append-only promotion log ``(dataset_id, model, promoted_at)``:
    the model promoted last per dataset is production, every other model staging."""
    latest = promotions.groupBy("dataset_id", "model").agg(F.max("promoted_at").alias("last_promoted"))
    champ = latest.groupBy("dataset_id").agg(F.max_by("model", F.struct("last_promoted", "model")).alias("__prod"))
    return (latest.join(champ, "dataset_id")
            .select("dataset_id", "model", "last_promoted",
                    F.when(F.col("model") == F.col("__prod"), "production").otherwise("staging").alias("stage")))


def recent_datasets(datasets: DataFrame, n: int = 20, project_id=None) -> DataFrame:
    src = datasets.where(F.col("project_id") == project_id) if project_id is not None else datasets
    return src.orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def eval_staleness(datasets: DataFrame) -> DataFrame:
    """An evaluation older than the latest training is stale."""
    return datasets.select("id", F.when(F.col("evaluated_at").isNull(), "missing")
                           .when(F.col("evaluated_at") < F.col("trained_at"), "stale").otherwise("fresh").alias("evaluation"))
