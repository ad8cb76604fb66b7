"""FIXTURES §5 edge frames through the main operators: they must run and stay sane."""
import math

import pytest
from pyspark.sql import functions as F

from tabwork.operators import clean as C
from tabwork.operators import evaluate as E
from tabwork.operators import features as FE
from tabwork.operators import profile as P
from tabwork.operators import sampling as S

EDGE = {
    "empty": [],
    "one_row": [(1, 1.0, "a")],
    "all_null": [(1, None, None), (2, None, None)],
    "nan_inf": [(1, float("nan"), "a"), (2, float("inf"), "b"), (3, float("-inf"), "b"), (4, 1.0, "a")],
    "constant": [(i, 5.0, "x") for i in range(6)],
    "ties": [(1, 2.0, "a"), (2, 2.0, "b"), (3, 1.0, "a"), (4, 1.0, "b")],
    "duplicates": [(1, 1.0, "a"), (1, 1.0, "a")],
    "negative_zero": [(1, -3.0, "a"), (2, 0.0, "b"), (3, 4.0, "a")],
}
SCHEMA = "id long, x double, c string"


@pytest.mark.parametrize("name", sorted(EDGE))
def test_profile_and_clean_on_edge_frames(spark, name):
    df = spark.createDataFrame(EDGE[name], SCHEMA).repartition(4)  # more partitions than rows
    cols = P.profile_columns(df).collect()
    assert {r.column_name for r in cols} == {"id", "x", "c"}
    for r in cols:
        for k in ("mean", "std", "skewness", "kurtosis"):
            v = r[k]
            assert v is None or math.isfinite(v)
    ds = P.profile_dataset(df).first()
    assert ds.row_count == len(EDGE[name])
    P.profile_histogram(df).collect()
    out = C.clean_apply(df, [{"column_name": "x", "strategy": "median_impute"},
                             {"column_name": "x", "strategy": "clip_outliers"},
                             {"column_name": "c", "strategy": "mode_impute"}])
    assert out.count() == len(EDGE[name])


@pytest.mark.parametrize("name", ["one_row", "constant", "negative_zero", "all_null"])
def test_feature_transforms_on_edge_frames(spark, name):
    df = spark.createDataFrame(EDGE[name], SCHEMA)
    specs = [{"source_column": "x", "output_name": "lx", "transform": "log"},
             {"source_column": "x", "output_name": "sx", "transform": "sqrt"},
             {"source_column": "x", "output_name": "zx", "transform": "standard_scale"},
             {"source_column": "x", "output_name": "mx", "transform": "min_max_scale"},
             {"source_column": "c", "output_name": "oc", "transform": "one_hot_encode"},
             {"source_column": "c", "output_name": "lc", "transform": "label_encode"}]
    rows = FE.feature_apply(df, specs).collect()
    for r in rows:
        for k in ("lx", "sx", "zx", "mx"):
            assert r[k] is None or math.isfinite(r[k])


def test_probability_edges_and_single_class(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 1.0)], "label double, probability double")
    h = E.eval_prediction_histogram(df).collect()
    assert sum(r.count_positive + r.count_negative for r in h) == 3   # p = 1.0 kept (Q13)
    cal = E.eval_calibration(df).collect()
    assert sum(r.n for r in cal) == 3
    single = spark.createDataFrame([(1.0, 0.3), (1.0, 0.9)], "label double, probability double")
    assert E.eval_auc_roc(single).first().auc is None


def test_unseen_category_and_target_encoding(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 0.0, 1), ("b", 1.0, 0), ("c", 1.0, 1)], "c string, y double, fold int")
    out = FE.fe_target_encode(df, "c", "y", "fold").collect()
    assert all(r.c_te is not None for r in out)          # unseen in other fold -> prior


def test_single_class_sampling(spark):
    df = spark.createDataFrame([(i, "a") for i in range(10)], "id long, y string")
    assert S.undersample_random(df, "y", "id").count() == 10
    assert S.oversample_random(df, "y", "id").count() == 10


def test_clean_apply_with_checkpointed_stages(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 3.0, "b"), (3, 5.0, None)], SCHEMA)
    acts = [{"column_name": "__all__", "strategy": "drop_rows"}, {"column_name": "x", "strategy": "mean_impute"},
            {"column_name": "c", "strategy": "drop_rows"}, {"column_name": "x", "strategy": "clip_outliers"}]
    a = sorted(map(tuple, C.clean_apply(df, acts).collect()), key=str)
    b = sorted(map(tuple, C.clean_apply(df, acts, checkpoint_stages=True).collect()), key=str)
    assert a == b and len(a) == 2


def test_clean_apply_persisted_stages_same_result(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 3.0, "b"), (3, 5.0, None), (4, 9.0, "c")], SCHEMA)
    acts = [{"column_name": "__all__", "strategy": "drop_rows"}, {"column_name": "x", "strategy": "median_impute"},
            {"column_name": "x", "strategy": "clip_outliers"}]
    a = sorted(map(tuple, C.clean_apply(df, acts).collect()), key=str)
    b = sorted(map(tuple, C.clean_apply(df, acts, persist_stages=True).collect()), key=str)
    spark.catalog.clearCache()
    assert a == b and len(a) == 4
