"""Sampling, splitting and class balance (survey §2.8).

Randomness is a hash of (id, seed), never ``rand()``: samples, splits and
folds are identical after a repartition or a retried task.  Exact per-class
ranks come from a bucketed running count over the row hash, so a class
holding a third of all rows is still ranked by many tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import cumulative_sum

# Advice thresholds and split defaults of the reference.
RATIO_SMOTE = 10
RATIO_WEIGHTS = 3
TEST_SIZE = 0.2
VAL_SIZE = 0.1
SEED = 42


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return (df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class"))
            .agg(F.count(F.lit(1)).alias("n_class")))


def imbalance_report(df: DataFrame, label: str) -> DataFrame:
    """All classes with count and share of non-null rows, max/min ratio and advice (quirk Q7)."""
    cc = class_counts(df, label)
    all_ = cc.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"), F.max("n_class").alias("mx"),
                  F.min("n_class").alias("mn")).withColumn("__k", F.lit(0))  # one row
    t = (cc.select(F.col("class").cast("string").alias("label"), F.col("n_class").alias("count"), F.lit(0).alias("__k"))
         .join(F.broadcast(all_), "__k"))
    ratio = F.when(F.col("k") >= 2, F.round(F.col("mx") / F.greatest(F.col("mn"), F.lit(1)), 2)).otherwise(F.lit(1.0))
    return t.select("label", "count", F.round(F.col("count") / F.col("n"), 4).alias("pct"),
                    ratio.alias("imbalance_ratio"),
                    F.when(ratio > RATIO_SMOTE, "oversample_smote").when(ratio > RATIO_WEIGHTS, "class_weights")
                    .otherwise("none").alias("recommended_strategy"))


def class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """``balanced`` weights n / (k · n_c), attached by a join of class counts."""
    cc = class_counts(df, label)
    tot = cc.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    wts = (cc.withColumn("__k", F.lit(0)).join(F.broadcast(tot.withColumn("__k", F.lit(0))), "__k")
           .select(F.col("class").alias(label), (F.col("n") / (F.col("k") * F.col("n_class"))).alias(weight_col)))
    return df.join(wts, label, "left")


def row_hash(id_col: str, seed: int = SEED):
    """52 bits of the md5 of "id:seed": any engine with md5 draws the same rows."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def hash_share(id_col: str, seed: int = SEED):
    """The hash as a number from 0 to below 1."""
    return row_hash(id_col, seed) / F.lit(float(1 << 52))


def rank_in_class(df: DataFrame, label: str, id_col: str, seed: int = SEED, name: str = "__rank") -> DataFrame:
    """1-based rank of each row inside its class by hash(id, seed) — exact, skew-safe."""
    t = df.withColumn("__h", row_hash(id_col, seed)).withColumn("__one", F.lit(1).cast("long"))
    r = cumulative_sum(t, "__h", ["__one"], partition_cols=[label])
    return r.withColumnRenamed("__one_cum", name).drop("__h", "__one")


def undersample_random(df: DataFrame, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """Every class down to the minority size: rows with the smallest hashes per class."""
    cc = class_counts(df, label)
    m = cc.agg(F.min("n_class").alias("m"))
    r = rank_in_class(df.where(F.col(label).isNotNull()), label, id_col, seed)
    r = r.withColumn("__k", F.lit(0)).join(F.broadcast(m.withColumn("__k", F.lit(0))), "__k")
    return r.where(F.col("__rank") <= F.col("m")).drop("__rank", "__k", "m")


def oversample_random(df: DataFrame, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """Every class up to the majority size: whole copies plus a hash-ranked remainder."""
    cc = class_counts(df, label)
    mx = cc.agg(F.max("n_class").alias("M"))
    plan = (cc.withColumn("__k", F.lit(0)).join(F.broadcast(mx.withColumn("__k", F.lit(0))), "__k")
            .select(F.col("class").alias(label), (F.floor(F.col("M") / F.col("n_class"))).cast("long").alias("__copies"),
                    F.pmod(F.col("M"), F.col("n_class")).cast("long").alias("__rem")))
    r = rank_in_class(df.where(F.col(label).isNotNull()), label, id_col, seed).join(plan, label)
    n = F.col("__copies") + F.when(F.col("__rank") <= F.col("__rem"), 1).otherwise(0)
    out = r.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))))
    return out.drop("__rank", "__copies", "__rem")


def split_train_val_test(df: DataFrame, id_col: str, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
                         seed: int = SEED) -> DataFrame:
    """Hash split: bucket = pmod(hash(id, seed), 1000); test, then val, then train."""
    b = F.pmod(row_hash(id_col, seed), F.lit(1000))
    t, v = int(round(test_size * 1000)), int(round((test_size + val_size) * 1000))
    return df.withColumn("split", F.when(b < t, "test").when(b < v, "val").otherwise("train"))


def split_stratified(df: DataFrame, label: str, id_col: str, test_size: float = TEST_SIZE,
                     val_size: float = VAL_SIZE, seed: int = SEED) -> DataFrame:
    """Per class: the first round(test·n_c) rows by hash are test, the next round(val·n_c) val."""
    cc = class_counts(df, label).select(F.col("class").alias(label), "n_class")
    r = rank_in_class(df.where(F.col(label).isNotNull()), label, id_col, seed).join(cc, label)
    nt = F.round(F.col("n_class") * test_size)
    nv = F.round(F.col("n_class") * val_size)
    return r.withColumn("split", F.when(F.col("__rank") <= nt, "test").when(F.col("__rank") <= nt + nv, "val")
                        .otherwise("train")).drop("__rank", "n_class")


def folds_kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", F.pmod(row_hash(id_col, seed), F.lit(k)).cast("int"))


def folds_stratified(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Fold = (rank in class − 1) mod k: class shares per fold differ by at most one row."""
    r = rank_in_class(df.where(F.col(label).isNotNull()), label, id_col, seed)
    return r.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def folds_time_series(series: DataFrame, series_col: str, ts_col: str, n_splits: int = 5) -> DataFrame:
    """Expanding-window folds per series (TimeSeriesSplit): k = min(n_splits, max(2, n // 10)),
    test size n // (k + 1); rows may be train in several folds, so one row per (row, fold)."""
    t = series.withColumn("__one", F.lit(1).cast("long"))
    r = cumulative_sum(t.withColumn("__o", F.unix_micros(F.col(ts_col).cast("timestamp"))), "__o", ["__one"],
                       partition_cols=[series_col]).withColumnRenamed("__one_cum", "pos").drop("__o", "__one")
    sizes = r.groupBy(series_col).agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(n_splits), F.greatest(F.lit(2), F.floor(F.col("n") / 10)))
    plan = sizes.select(series_col, "n", k.cast("long").alias("k"),
                        F.floor(F.col("n") / (k + 1)).cast("long").alias("test_size"))
    j = r.join(plan, series_col)  # one row per series: may be large, AQE decides on broadcasting
    folds = j.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    train_end = F.col("n") - (F.col("k") - F.col("fold")) * F.col("test_size")
    role = (F.when(F.col("pos") <= train_end, "train")
            .when(F.col("pos") <= train_end + F.col("test_size"), "test"))
    return (folds.withColumn("role", role).where(F.col("role").isNotNull())
            .drop("n", "k", "test_size"))
