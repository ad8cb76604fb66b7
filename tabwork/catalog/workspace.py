"""Workspace queries (§2.14, recent_datasets of §2.2, eval_staleness of §2.11).

Metadata tables are derived from the driver tables: ``customer`` = projects,
``orders`` = datasets (status from the order status, phases done from the
priority digit, score from the price), ``events`` = audit log / runs / promotions.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workspace as W
from ..session import table
from .inputs import rounded

PROJECTS_EXPRS = [("id", "c_custkey"), ("name", "c_name"),
                  ("status", "CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'archived' END")]
R = "CAST(substr(o_orderpriority, 1, 1) AS INT)"
DATASETS_EXPRS = [
    ("id", "o_orderkey"), ("project_id", "o_custkey"),
    ("status", "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'failed' END"),
    ("updated_at", "o_orderdate"),
    ("pii_report", f"CASE WHEN {R} >= 1 THEN 'r' END"), ("profile_data", "CASE WHEN o_orderstatus = 'F' THEN 'r' END"),
    ("eda_report", f"CASE WHEN {R} >= 2 THEN 'r' END"), ("cleaning_plan", f"CASE WHEN {R} >= 3 THEN 'r' END"),
    ("sampling_config", f"CASE WHEN {R} >= 3 THEN 'r' END"), ("feature_plan", f"CASE WHEN {R} >= 4 THEN 'r' END"),
    ("selection_plan", f"CASE WHEN {R} >= 4 THEN 'r' END"), ("training_results", f"CASE WHEN {R} >= 4 THEN 'r' END"),
    ("evaluation_results", f"CASE WHEN {R} = 5 THEN 'r' END"),
    ("has_deployments", f"{R} = 5 AND o_totalprice > 300000"),
    ("best_cv_score", f"CASE WHEN {R} >= 4 THEN o_totalprice / 600000 END"),
    ("best_model", "CASE WHEN o_totalprice > 200000 THEN 'gbt' ELSE 'logistic' END"),
    ("trained_at", "o_orderdate"),
    ("evaluated_at", f"CASE WHEN {R} = 5 THEN o_orderdate + INTERVAL (o_custkey % 3 - 1) DAY END"),
]
AUDIT_EXPRS = [("id", "event_id"), ("project_id", "user_id"),
               ("actor", "CASE WHEN event_type = 'error' THEN 'system' ELSE 'user' || CAST(user_id AS STRING) END"),
               ("action", "event_type"), ("created_at", "ts")]
RUN_EXPRS = [("id", "event_id"), ("schedule_id", "user_id % 7"), ("dataset_id", "user_id"),
             ("status", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END"), ("started_at", "ts")]
PROMO_EXPRS = [("dataset_id", "user_id % 20"), ("model", "event_type"), ("promoted_at", "ts")]


def _sql(exprs, tbl):
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in exprs) + f" FROM {tbl})"


def _spark_expr(e: str) -> str:
    # the one dialect difference used here: day offsets
    return e.replace("INTERVAL (o_custkey % 3 - 1) DAY", "make_dt_interval(o_custkey % 3 - 1)")


def _df(spark, d, exprs, tbl):
    return table(spark, d, tbl).selectExpr(*[f"{_spark_expr(e)} AS {c}" for c, e in exprs])


def projects(spark, d):
    return _df(spark, d, PROJECTS_EXPRS, "customer")


def datasets(spark, d):
    return _df(spark, d, DATASETS_EXPRS, "orders")


def audit(spark, d):
    return _df(spark, d, AUDIT_EXPRS, "events")


PROJ, DS, AUD = _sql(PROJECTS_EXPRS, "customer"), _sql(DATASETS_EXPRS, "orders"), _sql(AUDIT_EXPRS, "events")
TS = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "'%Y-%m-%d %H:%M:%S'"


def _fmt(df, *cols):
    return df.withColumns({c: F.date_format(c, TS) for c in cols})


def q_phase_status(spark, d):
    return W.phase_status(datasets(spark, d))


def _phase_sql():
    cols = []
    for p in W.PHASES:
        if p in ("upload", "chat"):
            cond = "status = 'ready'"
        elif p == "deploy":
            cond = "training_results IS NOT NULL AND coalesce(has_deployments, FALSE)"
        else:
            cond = f"{W.PHASE_SOURCE[p]} IS NOT NULL"
        cols.append(f"CASE WHEN {cond} THEN 'done' ELSE 'pending' END AS {p}")
    return f"SELECT id, {', '.join(cols)} FROM {DS}"


def q_project_rollup(spark, d):
    return rounded(_fmt(W.project_rollup(projects(spark, d), datasets(spark, d), audit(spark, d)), "last_activity"))


ROLLUP_SQL = f"""
WITH dc AS (SELECT project_id, count(*) AS n FROM {DS} GROUP BY 1),
la AS (SELECT project_id, max(created_at) AS la FROM {AUD} GROUP BY 1),
b AS (SELECT project_id, max(best_cv_score) AS s, arg_max(best_model, (best_cv_score, best_model)) AS m
      FROM {DS} WHERE status = 'ready' AND best_cv_score IS NOT NULL GROUP BY 1)
SELECT p.id AS project_id, p.name, CAST(coalesce(dc.n, 0) AS BIGINT) AS dataset_count,
  strftime(la.la, {TS_SQL}) AS last_activity, round(round(b.s, 4), 5) AS best_cv_score, b.m AS best_model
FROM {PROJ} p LEFT JOIN dc ON p.id = dc.project_id LEFT JOIN la ON p.id = la.project_id LEFT JOIN b ON p.id = b.project_id"""


def q_project_detail(spark, d):
    return _fmt(W.project_detail(datasets(spark, d)), "updated_at").withColumn("rank", F.col("rank").cast("long"))


def _detail_sql():
    done = " + ".join(f"CASE WHEN {p} = 'done' THEN 1 ELSE 0 END" for p in W.PHASES)
    return f"""
SELECT d.id, d.project_id, d.status, strftime(d.updated_at, {TS_SQL}) AS updated_at, {done} AS phases_done,
  row_number() OVER (PARTITION BY d.project_id ORDER BY d.updated_at DESC, d.id DESC) AS rank
FROM {DS} d JOIN ({_phase_sql()}) ph ON d.id = ph.id"""


def q_project_activity(spark, d):
    out = W.project_activity(audit(spark, d), 50)
    return _fmt(out, "created_at").withColumn("rank", F.col("rank").cast("long"))


ACTIVITY_SQL = f"""
SELECT id, project_id, actor, action, strftime(created_at, {TS_SQL}) AS created_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank FROM {AUD}) WHERE rank <= 50"""


def q_platform_overview(spark, d):
    return W.platform_overview(projects(spark, d), datasets(spark, d), audit(spark, d))


OVERVIEW_SQL = f"""
SELECT (SELECT count(*) FROM {PROJ}) AS total_projects,
  (SELECT CAST(sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS BIGINT) FROM {PROJ}) AS active_projects,
  (SELECT count(*) FROM {DS}) AS total_datasets,
  (SELECT CAST(sum(CASE WHEN status = 'ready' THEN 1 ELSE 0 END) AS BIGINT) FROM {DS}) AS ready_datasets,
  (SELECT count(training_results) FROM {DS}) AS models_trained,
  (SELECT CAST(sum(CASE WHEN training_results IS NOT NULL AND has_deployments THEN 1 ELSE 0 END) AS BIGINT) FROM {DS}) AS deployed_models,
  (SELECT count(DISTINCT actor) FROM {AUD} WHERE actor <> 'system') AS active_users"""


def q_activity_feed(spark, d):
    return _fmt(W.activity_feed(audit(spark, d), 50), "created_at")


FEED_SQL = f"SELECT id, project_id, actor, action, strftime(created_at, {TS_SQL}) AS created_at FROM {AUD} ORDER BY created_at DESC, id DESC LIMIT 50"


def q_run_history(spark, d):
    runs = _df(spark, d, RUN_EXPRS, "events")
    return _fmt(W.run_history(runs, schedule_id=3), "started_at")


RUNS_SQL = f"SELECT id, schedule_id, dataset_id, status, strftime(started_at, {TS_SQL}) AS started_at FROM {_sql(RUN_EXPRS, 'events')} WHERE schedule_id = 3"


def q_current_production(spark, d):
    return _fmt(W.current_production(_df(spark, d, PROMO_EXPRS, "events")), "last_promoted")


PROD_SQL = f"""
WITH l AS (SELECT dataset_id, model, max(promoted_at) AS lp FROM {_sql(PROMO_EXPRS, 'events')} GROUP BY ALL),
c AS (SELECT dataset_id, arg_max(model, (lp, model)) AS prod FROM l GROUP BY 1)
SELECT l.dataset_id, l.model, strftime(lp, {TS_SQL}) AS last_promoted,
  CASE WHEN l.model = c.prod THEN 'production' ELSE 'staging' END AS stage FROM l JOIN c ON l.dataset_id = c.dataset_id"""


def q_recent_datasets(spark, d):
    return _fmt(W.recent_datasets(datasets(spark, d), 20).select("id", "project_id", "status", "updated_at"), "updated_at")


RECENT_SQL = f"SELECT id, project_id, status, strftime(updated_at, {TS_SQL}) AS updated_at FROM {DS} ORDER BY updated_at DESC, id DESC LIMIT 20"


def q_eval_staleness(spark, d):
    return W.eval_staleness(datasets(spark, d))


STALE_SQL = f"""SELECT id, CASE WHEN evaluated_at IS NULL THEN 'missing' WHEN evaluated_at < trained_at THEN 'stale'
ELSE 'fresh' END AS evaluation FROM {DS}"""


QUERIES = {
    "phase_status": q_phase_status,
    "project_rollup": q_project_rollup,
    "project_detail": q_project_detail,
    "project_activity": q_project_activity,
    "platform_overview": q_platform_overview,
    "activity_feed": q_activity_feed,
    "run_history": q_run_history,
    "current_production": q_current_production,
    "recent_datasets": q_recent_datasets,
    "eval_staleness": q_eval_staleness,
}

ORACLE = {
    "phase_status": _phase_sql(),
    "project_rollup": ROLLUP_SQL,
    "project_detail": _detail_sql(),
    "project_activity": ACTIVITY_SQL,
    "platform_overview": OVERVIEW_SQL,
    "activity_feed": FEED_SQL,
    "run_history": RUNS_SQL,
    "current_production": PROD_SQL,
    "recent_datasets": RECENT_SQL,
    "eval_staleness": STALE_SQL,
}
