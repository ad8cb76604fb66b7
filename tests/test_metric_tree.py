import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwork.operators import metric_tree as M


def frame(spark, x, roots=None):
    rows = [(i, [float(c) for c in v], 1, roots[i] if roots else "0") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "pid long, x array<double>, m long, root string").repartition(4)


@pytest.mark.parametrize("dims", [1, 3])
def test_every_leaf_within_the_radius_is_visited(spark, dims):
    r = np.random.default_rng(dims)
    x = np.concatenate([r.normal(size=(250, dims)), 1e-3 * r.normal(size=(150, dims)) + 5, 1e6 + r.normal(size=(40, dims))])
    tree = M.build(frame(spark, x), 5, lambda n, w: n > 3)
    assert len(tree.levels) >= 2
    points = tree.points.collect()
    assert sorted(p.pid for p in points) == list(range(len(x)))
    leaf = {p.pid: p.node for p in points}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    up = {p.pid: p.up for p in points}
    kth = np.sort(d, axis=1)[:, 3]
    assert all(up[i] >= kth[i] * (1 - 1e-12) for i in range(len(x)))  # the bound holds
    for radius in (0.0, 0.05, 1.0):
        got = {}
        for v in M.visits(tree, frame(spark, x).withColumn("r", F.lit(radius))).collect():
            got.setdefault(v.pid, []).append(v.node)
        for i in range(len(x)):
            assert len(got[i]) == len(set(got[i]))
            assert {leaf[j] for j in np.flatnonzero(d[i] <= radius)} <= set(got[i])
    everywhere = M.visits(tree, frame(spark, x[:3]).withColumn("r", F.lit(None).cast("double")))
    assert everywhere.count() == 3 * len(set(leaf.values()))


def test_trees_of_several_roots(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 2))
    roots = ["a" if i < 200 else "b" if i < 299 else "c" for i in range(300)]
    tree = M.build(frame(spark, x, roots), 20, lambda n, w: w >= 5)
    asked = frame(spark, np.zeros((3, 2)), ["a", "b", "c"]).withColumn("r", F.lit(0.5))
    for v in M.visits(tree, asked).collect():
        assert v.node.split("/")[0] == v.root
    homes = {h.root: h for h in M.homes(tree, asked).collect()}
    assert homes["c"].node == "c" and homes["c"].up is None or np.isnan(homes["c"].up)
    near = np.sort(np.linalg.norm(x[:200], axis=1))[4]
    assert homes["a"].up >= near


def test_points_that_cannot_be_parted(spark):
    x = np.concatenate([np.zeros((40, 2)), np.ones((3, 2))])  # equal points are a caller's fault, but end
    tree = M.build(frame(spark, x), 8)
    assert tree.points.count() == 43


def test_comparisons_per_point_do_not_grow_with_the_points(spark):
    def taken(n):
        r = np.random.default_rng(n)
        x = r.uniform(size=(n, 3))
        tree = M.build(frame(spark, x), 32)
        guests = M.visits(tree, frame(spark, x).withColumn("r", F.lit(float((2 / n) ** (1 / 3)))))  # a few points each
        return M.comparisons(tree.points, guests) / n

    few, many = taken(2_000), taken(10_000)
    assert many < 1.5 * few


@pytest.mark.parametrize("radius", [0.3, None])
def test_calls_name_the_leaves_that_are_visited(spark, radius):
    # one row per parent of leaves, not one per leaf, and the home leaf left out
    r = np.random.default_rng(11)
    x = np.concatenate([r.normal(size=(300, 8)), np.full((40, 8), 4.0), r.normal(size=(60, 8)) * 1e-3 + 7])
    tree = M.build(frame(spark, x), 10, lambda n, w: n > 3)
    home = {p.pid: p.node for p in tree.points.collect()}
    asked = tree.points.select("pid", "x", F.col("node").alias("home")).withColumn("r", F.lit(radius).cast("double"))
    want = {(v.pid, v.node) for v in M.visits(tree, asked).collect() if v.node != home[v.pid]}
    calls = M.calls(tree, asked).collect()
    got = [(c.pid, f"{c.node}/{leaf}") for c in calls for leaf in c.leaves]
    assert len(got) == len(set(got)) and set(got) == want
    places = {p.pid: f"{p.node}/{p.leaves}" for p in M.residents(tree.points).collect()}
    assert places == home
    if radius is None:
        assert len(calls) < len(want) / 4
