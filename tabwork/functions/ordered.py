"""Order-dependent building blocks that stay distributed.

A window without ``partitionBy`` funnels every row into one task.  The two
helpers here avoid that:

* ``top_k_per_group`` ranks inside salted sub-groups first, so a group holding
  a third of all rows is still ranked by many tasks, then ranks the small set
  of survivors.
* ``cumulative_sum`` computes running totals over a global order in two
  passes: rows are put into range buckets, each bucket is summed (a small
  frame), bucket offsets are joined back and added to a per-bucket running
  window.  With groups the ranges are those of (group, value), so a hot group
  spans many buckets and many small groups share one.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SAMPLED = 64  # sampled rows per range bucket, from which the bounds of grouped ranges are taken


def _search(n: int, beyond) -> Column:
    """How many of ``n`` sorted bounds a row lies beyond: a binary search written as nested conditions,
    compiled by Spark, so the cost per row is the logarithm of the number of bounds."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(beyond(mid), search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, n)


def bucket_of(x: Column, bounds: list[float]) -> Column:
    """Number of sorted ``bounds`` below ``x``."""
    return _search(len(bounds), lambda i: x > F.lit(float(bounds[i])))


def grouped_bucket(df: DataFrame, part: list[str], x: Column, n_buckets: int) -> Column:
    """Number of the range of (group, ``x``) that a row lies in; it rises with ``x`` inside a group.

    Groups are ordered by a hash, nulls of ``x`` come first.  The bounds are taken from a sample of
    at most about SAMPLED rows a bucket, chosen by a hash; they decide how even the ranges are, never
    the result, and stand in the plan as numbers, so a repeated task deals its rows alike.
    """
    group = F.xxhash64(*[F.col("`" + c + "`") for c in part])
    keys = df.select(group.alias("g"), x.alias("x"))
    share = min(1.0, SAMPLED * n_buckets / max(1, keys.count()))
    chosen = F.pmod(F.xxhash64("g", "x", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    seen = sorted((r.g, -math.inf if r.x is None else r.x) for r in keys.where(chosen).collect()
                  if r.x is None or not math.isnan(r.x))
    bounds = sorted({seen[len(seen) * i // n_buckets] for i in range(1, n_buckets)}) if seen else []

    def beyond(i: int) -> Column:
        g, v = bounds[i]
        return (group > F.lit(g)) | ((group == F.lit(g)) & F.coalesce(x > F.lit(float(v)), F.lit(False)))
    return _search(len(bounds), beyond)


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank", salt_buckets: int = 32) -> DataFrame:
    """Keep the first ``k`` rows of each group by ``order`` and number them 1..k.

    ``order`` must be a total order (add a final key) for deterministic output.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, "__salt").orderBy(*order)
    pre = (df.withColumn("__salt", salt)
             .withColumn("__r", F.row_number().over(w1))
             .where(F.col("__r") <= k)
             .drop("__salt", "__r"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def cumulative_sum(df: DataFrame, order_col: str, sum_cols: list[str],
                   n_buckets: int | None = None, suffix: str = "_cum",
                   partition_cols: list[str] = ()) -> DataFrame:
    """Running totals of ``sum_cols`` over ascending ``order_col`` (inclusive),
    optionally restarting per ``partition_cols`` group.

    ``order_col`` should be unique within a group (pre-aggregate ties with a
    ``groupBy`` first; that also absorbs any hot value by map-side combine).
    Range bounds come from approximate quantiles, or with groups from a sample of
    (group, value), so no group's rows ever have to sit in one task.
    """
    spark = df.sparkSession
    part = list(partition_cols)
    if n_buckets is None:
        n_buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(order_col).cast("double")
    if part:
        tagged = df.withColumn("__bucket", grouped_bucket(df, part, x, n_buckets))
    else:
        tagged = df.withColumn("__bucket", _order_buckets(df, order_col, n_buckets))
    totals = tagged.groupBy(*part, "__bucket").agg(*[F.sum(c).alias(c) for c in sum_cols])
    wo = (Window.partitionBy(*part) if part else Window).orderBy("__bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "__bucket", *[F.coalesce(F.sum(c).over(wo), F.lit(0)).alias("__off_" + c)
                                                 for c in sum_cols])
    w = Window.partitionBy(*part, "__bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.select("*", *[F.sum(c).over(w).alias("__run_" + c) for c in sum_cols])
    # offsets: n_buckets rows (bounded) without groups; at most groups + n_buckets rows with them
    out = out.join(offsets if part else F.broadcast(offsets), part + ["__bucket"])
    return out.select(*[F.col("`" + c + "`") for c in df.columns],
                      *[(F.col("__run_" + c) + F.col("__off_" + c)).alias(c + suffix) for c in sum_cols])


def _order_buckets(df: DataFrame, order_col: str, n_buckets: int) -> Column:
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10000).alias("b")).first()
    bounds = sorted(set(x for x in (row["b"] or []) if x is not None))
    return bucket_of(F.col(order_col).cast("double"), bounds)


def fill_nulls_ordered(df: DataFrame, col: str, order_col: str, partition_cols: list[str] = (),
                       backward: bool = False, n_buckets: int | None = None) -> DataFrame:
    """Forward (or backward) fill of ``col`` along ``order_col``, within ``partition_cols`` if given.

    The table is cut into range buckets of the order column; each (key, bucket) fills locally, the
    last non-null value of every one (at most a row per key and bucket) is carried along the key's
    buckets and joined back for the leading nulls of the next — neither all rows nor the rows of one
    key ever sit in one task.  ``order_col`` must be numeric and unique within a key.
    """
    c = F.col("`" + col + "`")
    part = list(partition_cols)
    if n_buckets is None:
        n_buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tagged = df.withColumn("__b", _order_buckets(df, order_col, n_buckets))
    group = [*[F.col("`" + p + "`") for p in part], F.col("__b")]
    # descending order with a preceding frame: Spark evaluates "current row .. unbounded following"
    # frames row by row, which is quadratic
    along = F.desc(order_col) if backward else F.asc(order_col)
    w = Window.partitionBy(*group).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    local = F.last(c, ignorenulls=True).over(w)
    pick = F.min_by if backward else F.max_by
    # every (key, bucket), so that one without any value still passes the carried one along; the
    # order of null values is null, so they are never picked
    edge = tagged.groupBy(*group).agg(pick(c, F.when(c.isNotNull(), F.col(order_col))).alias("__edge"))
    wc = Window.partitionBy(*group[:-1]).orderBy(F.desc("__b") if backward else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*[g.alias(f"__k{i}") for i, g in enumerate(group[:-1])], F.col("__b").alias("__cb"),
                        F.last("__edge", ignorenulls=True).over(wc).alias("__carry"))
    same = F.col("__b") == F.col("__cb")
    for i, p in enumerate(part):
        same = same & F.col("`" + p + "`").eqNullSafe(F.col(f"__k{i}"))
    # without a key there are at most n_buckets rows; with one Spark decides by the size
    out = tagged.withColumn("__local", local).join(carry if part else F.broadcast(carry), same, "left")
    cols = [F.coalesce(F.col("__local"), F.col("__carry")).alias(col) if f == col else F.col("`" + f + "`")
            for f in df.columns]
    return out.select(*cols)
