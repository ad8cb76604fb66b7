"""A metric tree over points, built and searched level by level as Spark jobs.

A node with more than ``leaf`` points is split by a few k-means steps on a bounded sample of its points
into at most FAN children; every point goes to its nearest child.  A node keeps, for each child, the
centre, the radius (the largest distance of any of its points) and how much it holds.  All nodes of a
level are split by the same jobs, so depth grows with the logarithm of the points, and no table of nodes is
ever held whole by the driver or a task: a node's children meet the points that ask for them in
blocks of ASKED points.

A search carries each query down with a radius and passes over a child when the query is farther from it
than the radius by either bound: the distance to the centre less the child's radius (triangle
inequality), or the distance to the boundary between the child and the query's nearest centre.  Both hold
in any number of dimensions, so nothing within the radius is missed.

Points must be different from each other within a root (equal points carry a multiplicity ``m``); a
node that its centres cannot part stays a leaf, whatever its size, and is compared in blocks.  Several
trees can be built at once: a point's ``root`` names its tree, and a query only meets that tree.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LEAF = 512          # points that need no further split
FAN = 64            # children of a node at most
SPLIT_SAMPLE = 4096  # points of a node its centres are fitted on
ASKED = 16_384      # points that meet a node's children in one task
STEPS = 4           # k-means steps of a split
SLACK = 1e-9        # rounding allowed for in the bounds


def kept(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@dataclass
class Tree:
    points: DataFrame         # the points, with ``node`` (their leaf) and ``up``
    levels: list[DataFrame]   # one row per inner node: its children


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances from differences (no cancellation), a bounded part of the temporaries at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for i in range(0, len(x), step):
        out[i:i + step] = ((x[i:i + step, None] - y[None]) ** 2).sum(axis=2)
    return out


def _split(leaf: int):
    def split(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid", kind="stable")
        x = np.stack(frame.x.to_numpy())
        want = int(min(FAN, max(2, -(-2 * int(frame.n.iloc[0]) // leaf)), len(x)))
        centres = np.unique(x[np.linspace(0, len(x) - 1, want).astype(int)], axis=0)
        for _ in range(STEPS):
            near = squared(x, centres).argmin(axis=1)
            used = np.unique(near)
            centres = np.unique(np.stack([x[near == c].mean(axis=0) for c in used]), axis=0)
        return pd.DataFrame({"node": [key[0]], "dims": [x.shape[1]], "centres": [centres.ravel().tolist()]})

    return split


def _centres(node: pd.Series) -> np.ndarray:
    return np.asarray(node.centres, float).reshape(-1, int(node.dims))


def _via(enough):
    """For each child, how far beyond its centre enough points of the node are certain to lie."""
    def look(batches):
        for frame in batches:
            found = []
            for _, node in frame.iterrows():
                radius, n, w = (np.asarray(node[c], float) for c in ("radius", "many", "w"))
                middle = _centres(node)[np.asarray(node["at"], int)]
                reach = np.sqrt(squared(middle, middle)) + radius  # of every child, from every centre
                all_ = reach.max(axis=1) if enough(n.sum(), w.sum()) else np.full(len(n), np.inf)
                found.append(np.minimum(all_, np.where(enough(n, w), reach, np.inf).min(axis=1)).tolist())
            yield frame.assign(via=found)

    return look


def _met(asking: DataFrame, nodes: DataFrame, meet, schema: str) -> DataFrame:
    """``meet(points, node row)`` for blocks of the rows that ask at each node."""
    sizes = kept(asking.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks")))
    dealt = asking.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).drop("blocks")
    copies = nodes.join(sizes, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0].strip("`"): [] for c in schema.split(", ")})
        return meet(left, right.iloc[0])

    return dealt.groupBy("node", "block").cogroup(copies.groupBy("node", "block")).applyInPandas(task, schema)


def build(points: DataFrame, leaf: int = LEAF, enough=lambda n, w: n < 0) -> Tree:
    """The tree of ``points`` (pid, x, m and any other columns; ``root`` if there are several trees).

    ``enough(n, w)`` says, in numpy, whether n points of multiplicity w are as many as a search wants;
    ``up`` of a point is a distance within which there are so many, null where its root is a leaf.
    """
    named = points.withColumn("node", F.col("root") if "root" in points.columns else F.lit("0"))
    current = kept(named.withColumn("up", F.lit(None).cast("double")))
    sizes = kept(current.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    big = F.col("n") > leaf
    small = current.join(sizes.where(~big), "node").drop("n")
    found, levels = [small], []
    current, sizes = current.join(sizes.where(big), "node"), sizes.where(big)
    while not sizes.isEmpty():
        share = F.pmod(F.xxhash64("pid", F.lit(len(levels))), F.lit(1 << 30)) * F.col("n") < F.lit(SPLIT_SAMPLE * (1 << 30))
        fitted = kept(current.where(share).select("node", "n", "pid", "x").groupBy("node")
                      .applyInPandas(_split(leaf), "node string, dims int, centres array<double>"))
        # a node whose sample is empty by chance is a leaf, like one that cannot be parted
        stuck = current.join(fitted.select("node"), "node", "left_anti").drop("n")
        row = _schema(current)

        def place(left: pd.DataFrame, node: pd.Series) -> pd.DataFrame:
            x = np.stack(left.x.to_numpy())
            d = squared(x, _centres(node))
            at = d.argmin(axis=1)
            return left.drop(columns="block").assign(at=at, d=np.sqrt(d[np.arange(len(x)), at]))

        placed = kept(_met(current, fitted, place, f"{row}, at int, d double"))
        stats = placed.groupBy("node", "at").agg(F.count(F.lit(1)).alias("many"), F.sum("m").alias("w"),
                                                 F.max("d").alias("radius"), F.first("n").alias("of"))
        stats = kept(stats.withColumn("last", (F.col("many") <= leaf) | (F.col("many") == F.col("of"))))
        names = ["at", "radius", "many", "w", "last"]
        kids = stats.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("kids"))  # at most FAN
        level = fitted.join(kids, "node").select("node", "dims", "centres", *[F.col(f"kids.{c}").alias(c) for c in names])
        level = kept(level.mapInPandas(_via(enough), f"{_schema(level)}, via array<double>"))
        levels.append(level)
        each = level.select("node", F.explode(F.arrays_zip("at", "many", "last", "via")).alias("k"))
        each = each.select("node", "k.at", F.col("k.many").alias("n"), "k.last", "k.via")
        moved = (placed.drop("n").join(each, ["node", "at"])
                 .withColumn("up", F.least("up", F.when(F.col("via") < float("inf"), F.col("d") + F.col("via"))))
                 .withColumn("node", F.concat_ws("/", "node", "at")).drop("at", "d", "via"))
        moved = kept(moved)
        found += [stuck, moved.where("last").drop("n", "last")]
        current = moved.where("not last").drop("last")
        sizes = current.groupBy("node").agg(F.first("n").alias("n"))
    columns = [c for c in named.columns] + ["up"]
    out = found[0].select(*columns)
    for part in found[1:]:
        out = out.unionByName(part.select(*columns))
    return Tree(kept(out), levels)


def _asked(tree: Tree, queries: DataFrame, choose) -> DataFrame:
    """Carry ``queries`` (pid, x, ...) down from their roots; a row for every leaf that ``choose`` leads them to."""
    at = kept(queries.withColumn("node", F.col("root") if "root" in queries.columns else F.lit("0")))
    row = _schema(at)
    out = []
    for level in tree.levels:
        inner = level.select("node")
        out.append(at.join(inner, "node", "left_anti"))
        at = at.join(inner, "node", "left_semi")
        at = kept(_met(at, level, choose, row))
    out.append(at)
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return kept(found)


def homes(tree: Tree, queries: DataFrame) -> DataFrame:
    """``queries`` (pid, x, root, ...) with ``node``, the leaf reached through the nearest centres, and ``up`` as in ``build``."""
    def choose(left: pd.DataFrame, node: pd.Series) -> pd.DataFrame:
        x = np.stack(left.x.to_numpy())
        at = np.asarray(node["at"], int)
        d = np.sqrt(squared(x, _centres(node)[at]))
        to = d.argmin(axis=1)
        reach = d[np.arange(len(x)), to] + np.asarray(node.via, float)[to]
        up = np.fmin(left.up.to_numpy(float), np.where(reach < np.inf, reach, np.nan))
        return left.drop(columns="block").assign(node=[f"{node.node}/{a}" for a in at[to]], up=up)

    return _asked(tree, queries.withColumn("up", F.lit(None).cast("double")), choose)


def _within(left: pd.DataFrame, node: pd.Series, radius: str) -> np.ndarray:
    """Which children of ``node`` may hold a point within the radius of each row."""
    x, r = np.stack(left.x.to_numpy()), left[radius].to_numpy(float)
    centres = _centres(node)
    d2 = squared(x, centres)
    home = d2.argmin(axis=1)
    apart = np.sqrt(squared(centres, centres))[home]
    d = np.sqrt(d2)
    border = (d2 - d2[np.arange(len(x)), home][:, None]) / np.maximum(2 * apart, 1e-300)
    border[np.arange(len(x)), home] = 0.0
    at = np.asarray(node["at"], int)
    gap = np.maximum(border[:, at], d[:, at] - np.asarray(node.radius, float))
    return ~(gap > r[:, None] + SLACK * (r[:, None] + d[:, at]))  # NaN: nothing is far


def _names(node: pd.Series) -> np.ndarray:
    return np.array([f"{node.node}/{a}" for a in np.asarray(node["at"], int)], object)


def visits(tree: Tree, queries: DataFrame, radius: str = "r") -> DataFrame:
    """A row of ``queries`` for every leaf (``node``) that may hold a point within ``radius``; null: every leaf."""
    def choose(left: pd.DataFrame, node: pd.Series) -> pd.DataFrame:
        row, kid = np.nonzero(_within(left, node, radius))
        return left.drop(columns="block").iloc[row].assign(node=_names(node)[kid])

    return _asked(tree, queries, choose)


def _placed(rows: DataFrame, leaf) -> DataFrame:
    """``rows`` with ``leaf(number)`` of their leaf among its siblings, and the parent of the leaf as ``node``."""
    number = F.element_at(F.split("node", "/"), -1).cast("int")
    return rows.withColumn("leaves", leaf(number)).withColumn("node", F.regexp_replace("node", "/?[^/]*$", ""))


def residents(points: DataFrame) -> DataFrame:
    """The points of a tree with one root by parents of leaves (``node``); ``leaves`` is the number of their leaf."""
    return _placed(points, lambda number: number)


def calls(tree: Tree, queries: DataFrame, radius: str = "r") -> DataFrame:
    """What ``visits`` finds, in a row per parent of leaves (``node``) in place of one per leaf; ``leaves`` are their numbers.

    Where many leaves are near, a query is written once for up to FAN of them.  The leaf that a column
    ``home`` names is left out.  For trees with one root.
    """
    own = "home" in queries.columns
    at = kept(queries.withColumn("node", F.lit("0")).withColumn("leaves", F.lit(None).cast("array<int>")))
    row = _schema(at)

    def choose(left: pd.DataFrame, node: pd.Series) -> pd.DataFrame:
        names, near = _names(node), _within(left, node, radius)
        if own:
            near &= left.home.to_numpy(object)[:, None] != names[None]
        last, at = np.asarray(node["last"], bool), np.asarray(node["at"], int)
        left = left.drop(columns=["block", "leaves"])
        r, kid = np.nonzero(near & ~last)
        deeper = left.iloc[r].assign(node=names[kid], leaves=None)
        listed = np.flatnonzero((near & last).any(axis=1))
        here = left.iloc[listed].assign(node=node.node, leaves=[at[near[i] & last].tolist() for i in listed])
        return pd.concat([f for f in (deeper, here) if len(f)]) if len(deeper) or len(here) else deeper

    found = []
    stuck = (lambda rows: rows.where("node <> home")) if own else (lambda rows: rows)
    ended = lambda rows: _placed(stuck(rows), lambda number: F.array(number))
    for level in tree.levels:
        inner = level.select("node")
        found.append(ended(at.join(inner, "node", "left_anti")))
        told = kept(_met(at.join(inner, "node", "left_semi"), level, choose, row))
        found.append(told.where("leaves is not null"))
        at = told.where("leaves is null")
    found.append(ended(at))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return kept(out)


def compared(points: DataFrame, guests: DataFrame, compare, schema: str, block: int) -> DataFrame:
    """``compare(guests, points)`` for every pair of blocks that meet in a leaf (``node`` in both)."""
    own = points.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nh"))
    met = guests.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("ng"))
    sizes = kept(own.join(met, "node"))
    part = lambda n: F.pmod(F.xxhash64("pid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    g = guests.join(sizes, "node").withColumn("gb", part("ng")).withColumn("hb", every("nh")).drop("nh", "ng")
    h = points.join(sizes, "node").withColumn("hb", part("nh")).withColumn("gb", every("ng")).drop("nh", "ng")
    keys = ["node", "hb", "gb"]

    def task(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if not len(residents) or not len(visitors):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return compare(visitors, residents)

    g = g.toDF(*g.columns)  # both sides may come from one frame
    return g.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInPandas(task, schema)


def comparisons(points: DataFrame, guests: DataFrame) -> int:
    """How many distances ``compared`` takes."""
    own = points.groupBy("node").agg(F.count(F.lit(1)).alias("h"))
    met = guests.groupBy("node").agg(F.count(F.lit(1)).alias("g"))
    return own.join(met, "node").agg(F.sum(F.col("h") * F.col("g"))).first()[0] or 0
