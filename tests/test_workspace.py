import datetime as dt

from tabwork.operators import workspace as W


def test_project_rollup_left_joins_and_ready_only(spark):
    t = dt.datetime(2024, 1, 1)
    projects = spark.createDataFrame([(1, "p1", "active"), (2, "p2", "active")], "id long, name string, status string")
    ds = spark.createDataFrame(
        [(10, 1, "ready", 0.7, "gbt"), (11, 1, "processing", 0.99, "rf"), (12, 1, "ready", 0.8, "logistic")],
        "id long, project_id long, status string, best_cv_score double, best_model string")
    audit = spark.createDataFrame([(1, 1, "u1", "view", t)], "id long, project_id long, actor string, action string, created_at timestamp")
    r = {x.project_id: x for x in W.project_rollup(projects, ds, audit).collect()}
    assert r[1].dataset_count == 3 and r[1].best_cv_score == 0.8 and r[1].best_model == "logistic"
    assert r[2].dataset_count == 0 and r[2].best_cv_score is None and r[2].last_activity is None


def test_current_production_latest_promotion_wins(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "a", t), (1, "b", t + dt.timedelta(days=1)), (1, "a", t + dt.timedelta(days=2)),
                                 (2, "c", t)], "dataset_id long, model string, promoted_at timestamp")
    r = {(x.dataset_id, x.model): x.stage for x in W.current_production(log).collect()}
    assert r == {(1, "a"): "production", (1, "b"): "staging", (2, "c"): "production"}
