"""Exact quantiles without a single aggregation buffer.

``percentile`` keeps every distinct value of a column in one buffer, which
fails on huge columns; ``percentile_approx`` is bounded but approximate.
This computes the exact linear-interpolated quantile (pandas ``quantile``,
DuckDB ``quantile_cont``) as a plan:

1. value counts per (key, value) — one shuffle, map-side combined;
2. running counts per key over value order — bucketed, no single-task window;
3. the rows holding ranks floor(p·(n−1)) and ceil(p·(n−1)) found by an
   equi-join on the key with a range condition (targets: keys × probs × 2 rows);
4. interpolation.

Where groups are few and large, ``quantiles_between`` shuffles little of that: approximate quantiles bound
every wanted value, all values outside these bounds are merged into counts where they are read, and the
exact plan runs over what remains.  If bounds ever miss a wanted rank, the exact plan runs over all.
``means_and_quantiles`` does the same with bounds that the rows carry, and takes the means from the same pass.
"""
from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import q
from .ordered import cumulative_sum


def quantiles_long(long: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys..., p, value) for a long frame; nulls ignored."""
    vc = (long.where(F.col(value).isNotNull())
          .groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    return _of_counts(vc.withColumn("__t", F.col("__c")), keys, probs)


ACCURACY = 4000  # of the approximate quantiles: ranks are off by at most a row in so many
MARGIN = 3 / ACCURACY


def quantile_bounds(value: str, probs: list[float]):
    """Aggregate for ``quantiles_between``: values a little below and above every quantile."""
    ends = [min(1.0, max(0.0, p + side)) for p in probs for side in (-MARGIN, MARGIN)]
    return F.percentile_approx(F.col(value).cast("double"), ends, ACCURACY)


def quantile_bounds_wide(value: str, probs: list[float], margin: float):
    """``quantile_bounds`` for bounds taken from a sample of the rows, with a margin for that."""
    ends = [min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)]
    return F.percentile_approx(F.col(value).cast("double"), ends, ACCURACY)


def _near_counts(long: DataFrame, keys: list[str], value: str, ends: list, *more) -> DataFrame:
    """Counts of the values within ``ends``, of which there is a pair of columns per quantile; the others are merged."""
    x = F.col(value).cast("double")
    near = F.lit(False)
    for lo, hi in ends:
        near = near | x.between(lo, hi)
    # a value outside all bounds counts as one just above the next bound below it, or as least of all
    below = [F.when(x > hi, hi) for _, hi in ends]
    other = F.greatest(*below) if len(below) > 1 else below[0]
    return (long.where(F.col(value).isNotNull())
            .select(*keys, F.when(near, x).otherwise(other).alias("__v"), F.coalesce(near, F.lit(False)).cast("long").alias("__near"), x.alias("__x"))
            .groupBy(*keys, "__v").agg(F.sum("__near").alias("__c"), F.count(F.lit(1)).alias("__t"), *more))


def _found(vc: DataFrame, groups: int, keys: list[str], probs: list[float]) -> DataFrame | None:
    """The quantiles of ``groups`` groups from ``_near_counts``, None if the bounds missed any of them."""
    from ..operators.metric_tree import kept
    out = kept(_of_counts(vc, keys, probs))  # a row per group and quantile
    return out if out.count() == len(probs) * groups and out.where("value is null").isEmpty() else None


def quantiles_between(long: DataFrame, bounds: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """``quantiles_long`` of few, large groups; ``bounds`` holds a row per group: keys and ``quantile_bounds`` as ``__b``."""
    from ..operators.metric_tree import kept
    ends = [(F.col("__b")[2 * i], F.col("__b")[2 * i + 1]) for i in range(len(probs))]
    vc = kept(_near_counts(long.join(F.broadcast(bounds.select(*keys, "__b")), keys), keys, value, ends))
    out = _found(vc, bounds.where("__b is not null").count(), keys, probs)
    return quantiles_long(long, keys, value, probs) if out is None else out


def means_and_quantiles(long: DataFrame, keys: list[str], value: str, probs: list[float], ends: list) -> tuple[DataFrame, DataFrame]:
    """(keys..., mean) and ``quantiles_long`` from one pass over few, large groups; each row carries the bounds of
    its group, the pairs of columns ``ends``."""
    from ..operators.metric_tree import kept
    vc = kept(_near_counts(long, keys, value, ends, F.sum("__x").alias("__s")))
    means = kept(vc.groupBy(*keys).agg((F.sum("__s") / F.sum("__t")).alias("mean")))  # a row per group
    out = _found(vc, means.count(), keys, probs)
    return means, quantiles_long(long, keys, value, probs) if out is None else out


def _of_counts(vc: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Quantiles from (keys..., __v, __c, __t): ``__c`` rows of value ``__v`` and, after them, ``__t - __c`` rows of no
    value that is told; a quantile among these is null or left out."""
    cum = cumulative_sum(vc, "__v", ["__t"], partition_cols=keys)
    n = vc.groupBy(*keys).agg(F.sum("__t").alias("__n"))
    parr = F.array(*[F.lit(float(p)) for p in probs])
    tg = n.select(*keys, "__n", F.explode(parr).alias("p"))
    pos = F.col("p") * (F.col("__n") - 1)
    tg = tg.select(*keys, "p", pos.alias("__pos"), F.floor(pos).cast("long").alias("__lo"),
                   F.ceil(pos).cast("long").alias("__hi"))
    ranks = tg.select(*keys, "p", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.col("__lo").alias("rank")),
        F.struct(F.lit("hi").alias("side"), F.col("__hi").alias("rank")))).alias("r")).select(*keys, "p", "r.*")
    # ranks: keys × probs × 2 rows — small for columns or grid points, but it grows with
    # the number of groups, so AQE decides on broadcasting from the real size
    hit = cum.join(ranks, keys).where(
        (F.col("rank") >= F.col("__t_cum") - F.col("__t")) & (F.col("rank") < F.col("__t_cum") - F.col("__t") + F.col("__c")))
    vals = hit.groupBy(*keys, "p").agg(F.max(F.when(F.col("side") == "lo", F.col("__v"))).alias("vlo"),
                                       F.max(F.when(F.col("side") == "hi", F.col("__v"))).alias("vhi"))
    out = vals.join(tg, keys + ["p"])
    frac = F.col("__pos") - F.col("__lo")
    return out.select(*keys, "p", (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * frac).alias("value"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict:
    """{(column, p): value} for several columns at once (the result is columns × probs numbers)."""
    if not columns:
        return {}
    long = df.select(*[F.col(q(c)).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "__col", "__x")
    rows = quantiles_long(long, ["__col"], "__x", probs).collect()
    out = {(c, float(p)): None for c in columns for p in probs}
    for r in rows:
        out[(r["__col"], float(r["p"]))] = r["value"]
    return out
