"""Sampling / split / fold queries (§2.8).  Rows are chosen by an md5 of the id, which DuckDB
computes alike, so the oracles compare the chosen rows themselves."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..session import table
from .inputs import LINEITEM_OUTL_SQL, lineitem_outl, rounded

CLS_SQL = f"(SELECT rid, l_returnflag, CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS big_disc FROM ({LINEITEM_OUTL_SQL}))"


# the row hash of operators.sampling, and each row's rank in its class by it
HASH_SQL = "CAST('0x' || substr(md5(CAST(rid AS VARCHAR) || ':42'), 1, 13) AS BIGINT)"


def _ranked_sql(label):
    return (f"(SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {HASH_SQL}) AS rk, "
            f"count(*) OVER (PARTITION BY {label}) AS nc FROM {CLS_SQL} WHERE {label} IS NOT NULL)")


def li_cls(spark, d):
    return lineitem_outl(spark, d).select(
        "rid", "l_returnflag", F.when(F.col("l_discount") >= 0.09, 1).otherwise(0).alias("big_disc"))


def q_imbalance_report(spark, d):
    return rounded(S.imbalance_report(li_cls(spark, d), "big_disc"))


IMB_SQL = f"""
WITH c AS (SELECT CAST(big_disc AS VARCHAR) AS label, count(*) AS count FROM {CLS_SQL} GROUP BY 1),
a AS (SELECT sum(count) AS n, count(*) AS k, max(count) AS mx, min(count) AS mn FROM c),
r AS (SELECT c.*, n, CASE WHEN k >= 2 THEN round(mx / greatest(mn, 1), 2) ELSE 1.0 END AS ratio FROM c, a)
SELECT label, count, round(round(count / n, 4), 5) AS pct, round(ratio, 5) AS imbalance_ratio,
  CASE WHEN ratio > 10 THEN 'oversample_smote' WHEN ratio > 3 THEN 'class_weights' ELSE 'none' END AS recommended_strategy
FROM r"""


def q_class_weights(spark, d):
    return rounded(S.class_weights(li_cls(spark, d), "big_disc").select("rid", "big_disc", "weight"))


WEIGHTS_SQL = f"""
WITH t AS {CLS_SQL}, c AS (SELECT big_disc, count(*) AS nc FROM t GROUP BY 1),
a AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT rid, t.big_disc, round(n / (k * nc), 5) AS weight FROM t JOIN c ON t.big_disc = c.big_disc, a"""


def q_undersample_random(spark, d):
    return S.undersample_random(li_cls(spark, d), "big_disc", "rid").select("rid", "big_disc")


UNDER_SQL = f"""
WITH r AS {_ranked_sql("big_disc")}
SELECT rid, big_disc FROM r WHERE rk <= (SELECT min(nc) FROM r)"""


def q_oversample_random(spark, d):
    return S.oversample_random(li_cls(spark, d), "big_disc", "rid").select("rid", "big_disc", "copy")


OVER_SQL = f"""
WITH r AS {_ranked_sql("big_disc")}, m AS (SELECT max(nc) AS mx FROM r)
SELECT rid, big_disc, CAST(unnest(range(1, mx // nc + CASE WHEN rk <= mx % nc THEN 1 ELSE 0 END + 1)) AS BIGINT) AS copy
FROM r, m"""


def q_split_train_val_test(spark, d):
    return S.split_train_val_test(li_cls(spark, d), "rid").select("rid", "split")


SPLIT_SQL = f"""
SELECT rid, CASE WHEN {HASH_SQL} % 1000 < 200 THEN 'test' WHEN {HASH_SQL} % 1000 < 300 THEN 'val' ELSE 'train' END AS split
FROM {CLS_SQL}"""


def q_split_stratified(spark, d):
    return S.split_stratified(li_cls(spark, d), "l_returnflag", "rid").select("rid", "l_returnflag", "split")


STRAT_SPLIT_SQL = f"""
SELECT rid, l_returnflag, CASE WHEN rk <= round(nc * 0.2) THEN 'test' WHEN rk <= round(nc * 0.2) + round(nc * 0.1) THEN 'val'
  ELSE 'train' END AS split FROM {_ranked_sql("l_returnflag")}"""


def q_folds_kfold(spark, d):
    return S.folds_kfold(li_cls(spark, d), "rid").select("rid", F.col("fold").cast("long").alias("fold"))


KFOLD_SQL = f"SELECT rid, CAST({HASH_SQL} % 5 AS BIGINT) AS fold FROM {CLS_SQL}"


def q_folds_stratified(spark, d):
    f = S.folds_stratified(li_cls(spark, d), "l_returnflag", "rid")
    return f.select("rid", "l_returnflag", F.col("fold").cast("long").alias("fold"))


STRAT_FOLD_SQL = f"SELECT rid, l_returnflag, CAST((rk - 1) % 5 AS BIGINT) AS fold FROM {_ranked_sql('l_returnflag')}"


def daily_orders(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("series"), F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("y"))


DAILY_SQL = "(SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS day, count(*) AS y FROM orders GROUP BY 1, 2)"


def q_folds_time_series(spark, d):
    f = S.folds_time_series(daily_orders(spark, d), "series", "day")
    return f.groupBy("series", "fold", "role").agg(F.count(F.lit(1)).alias("n_rows"),
                                                   F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


TS_FOLD_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS pos,
                  count(*) OVER (PARTITION BY series) AS n FROM {DAILY_SQL}),
p AS (SELECT *, least(5, greatest(2, n // 10)) AS k FROM r),
q AS (SELECT *, n // (k + 1) AS ts FROM p),
f AS (SELECT q.*, CAST(fold AS BIGINT) AS fold FROM q, range(5) t(fold) WHERE fold < k),
x AS (SELECT series, fold, pos, CASE WHEN pos <= n - (k - fold) * ts THEN 'train'
                                     WHEN pos <= n - (k - fold) * ts + ts THEN 'test' END AS role FROM f)
SELECT series, fold, role, count(*) AS n_rows, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos
FROM x WHERE role IS NOT NULL GROUP BY ALL"""


QUERIES = {
    "imbalance_report": q_imbalance_report,
    "class_weights": q_class_weights,
    "undersample_random": q_undersample_random,
    "oversample_random": q_oversample_random,
    "split_train_val_test": q_split_train_val_test,
    "split_stratified": q_split_stratified,
    "folds_kfold": q_folds_kfold,
    "folds_stratified": q_folds_stratified,
    "folds_time_series": q_folds_time_series,
}

ORACLE = {
    "imbalance_report": IMB_SQL,
    "class_weights": WEIGHTS_SQL,
    "undersample_random": UNDER_SQL,
    "oversample_random": OVER_SQL,
    "split_train_val_test": SPLIT_SQL,
    "folds_kfold": KFOLD_SQL,
    "split_stratified": STRAT_SPLIT_SQL,
    "folds_stratified": STRAT_FOLD_SQL,
    "folds_time_series": TS_FOLD_SQL,
}
