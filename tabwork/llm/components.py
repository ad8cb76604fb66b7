"""Connected components by repeated contraction, with every round written to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``a``-``b`` (longs, either direction, repeats allowed).

    In a round every node points to the neighbour of least hash if that is less than its own hash;
    links are rewritten to the ends' targets and those inside one target vanish.  The hash changes
    with the round, so each round removes a constant share of the nodes and hubs cost no more than a
    pre-aggregated minimum.  ``root`` is some node of the component, the same for all its nodes.
    Nothing is collected; a table without links gives an empty result.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = saved(links.distinct(), "links")
    levels = []
    while not links.isEmpty():
        seed = F.lit(len(levels))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("node", seed).alias("h"), F.col("node").alias("to"))
        level = saved(least.select("node", F.least("m", own)["to"].alias("target")), "level")
        levels.append(level)
        to_a = level.select(F.col("node").alias("a"), F.col("target").alias("ta"))
        to_b = level.select(F.col("node").alias("b"), F.col("target").alias("tb"))
        moved = links.join(to_a, "a").join(to_b, "b").filter("ta <> tb")
        links = saved(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[-1].select("node", F.col("target").alias("root"))
    for level in reversed(levels[:-1]):
        after = found.select(F.col("node").alias("target"), "root")
        found = saved(level.join(after, "target", "left").select("node", F.coalesce("root", "target").alias("root")), "roots")
    return found
