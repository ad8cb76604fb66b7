import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwork.functions.ordered import cumulative_sum, fill_nulls_ordered, grouped_bucket, top_k_per_group
from tabwork.operators import evaluate as E


def test_cumulative_sum_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": np.arange(500), "v": rng.integers(0, 10, 500), "g": rng.integers(0, 3, 500)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = cumulative_sum(df, "k", ["v"], n_buckets=5).toPandas().sort_values("k")
    assert got.v_cum.tolist() == pdf.sort_values("k").v.cumsum().tolist()
    got = cumulative_sum(df, "k", ["v"], n_buckets=4, partition_cols=["g"]).toPandas().sort_values(["g", "k"])
    exp = pdf.sort_values(["g", "k"]).groupby("g").v.cumsum()
    assert got.v_cum.tolist() == exp.tolist()


def test_grouped_sums_with_hot_and_null_groups(spark):
    rng = np.random.default_rng(6)
    g = np.concatenate([np.full(4000, 7), rng.integers(0, 900, 2000)])
    pdf = pd.DataFrame({"g": g, "k": np.arange(6000) * 0.5 - 900, "v": rng.integers(0, 10, 6000)})
    df = spark.createDataFrame(pdf).select(F.when(F.col("g") > 0, F.col("g")).alias("g"), F.when(F.col("k") > -900, F.col("k")).alias("k"), "v")
    out = cumulative_sum(df.repartition(7).where("g IS NOT NULL"), "k", ["v"], n_buckets=16, partition_cols=["g"])
    got = out.toPandas().sort_values(["g", "k"], na_position="first")
    want = pdf[pdf.g > 0].sort_values(["g", "k"])
    assert got.v_cum.tolist() == want.groupby("g").v.cumsum().tolist()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "percentile_approx" not in plan
    # the hot group spans many ranges, no range holds much more than its share
    sizes = df.where("g IS NOT NULL").select(grouped_bucket(df.where("g IS NOT NULL"), ["g"], F.col("k"), 16).alias("b")).groupBy("b").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 3 * 6000 / 16


@pytest.mark.parametrize("backward", [False, True])
def test_fill_matches_pandas(spark, backward):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=300)
    vals[rng.random(300) < 0.6] = np.nan
    vals[:5] = np.nan
    pdf = pd.DataFrame({"o": np.arange(300), "x": vals, "g": np.arange(300) % 4})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x"))).repartition(5)
    exp = pdf.x.bfill() if backward else pdf.x.ffill()
    got = fill_nulls_ordered(df, "x", "o", backward=backward, n_buckets=6).toPandas().sort_values("o")
    assert np.allclose(got.x.fillna(-999).to_numpy(), exp.fillna(-999).to_numpy())
    expg = pdf.groupby("g").x.bfill() if backward else pdf.groupby("g").x.ffill()
    gotg = fill_nulls_ordered(df, "x", "o", ["g"], backward=backward).toPandas().sort_values("o")
    assert np.allclose(gotg.x.fillna(-999).to_numpy(), expg.fillna(-999).to_numpy())


def test_top_k_per_group_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, "w")], "g string, n int, v string")
    got = top_k_per_group(df, ["g"], [F.desc("n"), F.asc("v")], 2).orderBy("g", "rank").collect()
    assert [(r.g, r.v, r["rank"]) for r in got] == [("a", "y", 1), ("a", "z", 2), ("b", "w", 1)]


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200).astype(float)
    s = np.round(rng.random(200), 1)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "probability": s}))
    auc = E.eval_auc_roc(df).first()["auc"]
    assert abs(auc - _brute_auc(y, s)) < 1e-12


def test_threshold_sweep_matches_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300).astype(float)
    p = rng.random(300)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "probability": p}))
    rows = {r.threshold: r for r in E.eval_threshold_sweep(df, [0.2, 0.5, 0.8]).collect()}
    for t in (0.2, 0.5, 0.8):
        pr = p >= t
        assert rows[t].tp == int(((pr) & (y == 1)).sum()) and rows[t].tn == int(((~pr) & (y == 0)).sum())


def test_confusion_grid_complete_and_single_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "label string, prediction string")
    cm = E.eval_confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 3
    one = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    pc = E.eval_per_class(one).collect()
    assert len(pc) == 1 and pc[0].f1 == 1.0


def test_confusion_cells_are_the_observed_part_of_the_grid(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("c", None), (None, "c")], "label string, prediction string")
    got = {(r.actual, r.predicted): r for r in E.eval_confusion_cells(df).collect()}
    assert set(got) == {("a", "a"), ("a", "b"), ("c", None), (None, "c")}
    assert (got["a", "b"]["count"], got["a", "b"].actual_rows, got["a", "b"].predicted_rows, got["a", "b"].pct) == (2, 3, 2, 40.0)
    assert got[None, "c"].actual_rows == got["c", None].predicted_rows == 1
    many = spark.range(3000).selectExpr("CAST(id AS STRING) AS label", "CAST(id + id % 2 AS STRING) AS prediction")
    assert E.eval_confusion_cells(many).count() == 3000
    grid = {(r.actual, r.predicted): r["count"] for r in E.eval_confusion_matrix(df).collect()}
    assert len(grid) == 9 and all(grid[k] == v["count"] for k, v in got.items() if None not in k)
    assert E.eval_confusion_cells(df.limit(0)).collect() == []


def test_mcnemar_statistic(spark):
    rows = [(i, 1.0, 1.0, "a") for i in range(10)] + [(i, 1.0, 0.0, "b") for i in range(10)]
    rows += [(10 + i, 0.0, 1.0, "a") for i in range(2)] + [(10 + i, 0.0, 0.0, "b") for i in range(2)]
    df = spark.createDataFrame(rows, "id long, label double, prediction double, model string")
    r = E.eval_mcnemar(df, "a", "b").first()
    assert (r.ab, r.ba) == (10, 2)
    assert abs(r.statistic - (abs(10 - 2) - 1) ** 2 / 12) < 1e-12
    assert r.significant
