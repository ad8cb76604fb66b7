import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwork.operators import cells as C
from tabwork.operators import neighbours as N


def nested(dims, scales, n, seed=3):
    """Points in ever smaller clusters about the origin."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=(n, dims)) * 10.0 ** -s for s in range(scales)])


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), None, 1) for i, v in enumerate(x)], "pid long, x array<double>, label string, m long").repartition(4)


@pytest.mark.parametrize("dims", [1, 2, 9])
def test_every_cell_within_the_radius_is_called(dims):
    r = np.random.default_rng(dims)
    x = np.concatenate([r.normal(size=(300, dims)), np.round(r.normal(size=(200, dims))), np.full((60, dims), 5.0)])
    cells = C.cut(x[::3], 12)
    at = cells.of(x)
    assert len(cells.lo) > 8 and set(at) <= set(range(len(cells.lo)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for radius in (0.0, 0.4, np.inf):
        row, cell = cells.calls(x, np.full(len(x), radius))
        called = set(zip(row.tolist(), cell.tolist()))
        assert all((i, at[j]) in called for i, j in zip(*np.nonzero(d <= radius)))


@pytest.mark.parametrize("dims", [2, 40])
def test_leaves_find_what_differences_find(dims):
    r = np.random.default_rng(dims)
    x = np.concatenate([1e6 + r.normal(size=(150, dims)), 1e6 + 1e-4 * r.normal(size=(150, dims)), np.repeat(1e6 + r.normal(size=(5, dims)), 2, axis=0)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    leaves, pid = C.Leaves(x, 16), np.arange(len(x))
    row, at, far = leaves.nearest(pid, x, 7, np.full(len(x), np.inf), pid[leaves.order], piece=50)
    np.fill_diagonal(d, np.inf)
    want = [sorted((d[i, j], j) for j in range(len(x)))[:7] for i in range(len(x))]
    assert list(zip(far, leaves.order[at])) == [p for w in want for p in w]
    np.fill_diagonal(d, 0.0)
    eps = float(np.quantile(d, 0.3))
    got = np.zeros_like(d, bool)
    for rows, a, b, near in leaves.within(x, eps, piece=64):
        got[np.ix_(rows, leaves.order[a:b])] = near
    assert (got == (d <= eps)).all()


def test_estimated_sizes_stay_bounded(spark, capsys):
    # clusters inside clusters made a tree of many levels, whose checkpoints multiplied the estimated sizes of
    # their joins until these numbers alone filled the driver
    near = N.nearest(frame(spark, nested(2, 10, 40)), 3, per_cell=8)
    assert near.count() == 400
    near.explain("cost")
    sizes = re.findall(r"sizeInBytes=[\d.]+(?:E\+(\d+))? ", capsys.readouterr().out)
    assert sizes and all(int(e or 0) < 50 for e in sizes)


def test_cells_of_several_scales_equal_brute_force(spark):
    x = nested(3, 6, 60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {r.pid: [o.pid for o in r.near] for r in N.nearest(frame(spark, x), 4, per_cell=8, block=30).collect()}
    assert got == {i: [j for _, j in sorted((d[i, j], j) for j in range(len(x)))[:4]] for i in range(len(x))}
    some = N.nearest(frame(spark, x), 4, per_cell=8, block=30, wanted=F.col("pid") % 7 == 0).collect()
    assert {r.pid: [o.pid for o in r.near] for r in some} == {i: v for i, v in got.items() if i % 7 == 0}


def test_vectors_of_different_lengths_are_refused(spark):
    with pytest.raises(Exception, match="same number of dimensions"):
        N.nearest(frame(spark, [np.zeros(2), np.ones(4)]), 1).collect()


def test_links_inside_a_block_join_what_is_connected():
    r = np.random.default_rng(0)
    for share in (0.02, 0.1, 0.5):
        near = r.random((30, 40)) < share
        near[near.any(axis=1).argmin()] |= False
        row, column = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        links = N._spanned(near[np.ix_(row, column)], row, 30 + column)
        a, b = np.nonzero(near)
        every, few = N._linked(a, 30 + b, 70), N._linked(links[0], links[1], 70)
        assert (every == few).all() and links.shape[1] <= 2 * (len(row) + len(column))
        assert all(near[i, j - 30] for i, j in links.T)
