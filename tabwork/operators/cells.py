"""Cells of points, cut by planes, and exact search among them.

The planes come from a small sample of the points: a node is halved by its widest coordinate until there are
as many cells as wanted.  So a table of cells (two corners each) is all that the driver holds, and the
distance of a query to a cell's region bounds its distance to every point there, in any number of dimensions.
Cells hold at most about CELL points and VALUES numbers; each is a group of one task.

In a task the points of a cell are put in leaves of LEAF points by the same halving.  Leaves that a query's
radius does not reach are passed over; for the others a matrix product gives distances up to a known rounding
error, and only pairs that may lie within the radius are taken exactly, from differences.  So results do not
depend on cells or leaves, and where nothing can be passed over, as in many dimensions, a pair costs a product.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

LEAF = 256           # points of a leaf
CELL = 1 << 16       # points of a cell at most, about
CELL_LEAST = 1 << 12  # smaller cells are made only if asked for
VALUES = 1 << 22     # coordinates of a cell at most, about
SAMPLED = 64         # points per cell that place the planes
SAMPLED_LEAST = 4096
PENDING = 2          # pairs per row and neighbour that wait for their exact distance
ROUNDING = 1e-15     # per coordinate, of a matrix product
SLACK = 1e-9         # relative, of bounds


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it again: lineage ends, and its size is known."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vectors(column) -> np.ndarray:
    """The rows of an Arrow column of equally long lists of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError("vectors must have the same number of dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), int(sizes[0]) if len(sizes) else 0)


def lists(row: np.ndarray, n: int, values) -> pa.ListArray:
    """A list per number below ``n`` of the ``values`` whose (sorted) ``row`` it is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


@dataclass
class Cells:
    """Planes as a tree of nodes (``dim`` -1: a cell), and the corners of the cells' regions."""
    dim: np.ndarray
    split: np.ndarray
    down: np.ndarray
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(x), int), np.arange(len(x))
        while (inner := self.dim[at] >= 0).any():
            right = x[row, np.where(inner, self.dim[at], 0)] >= self.split[at]
            at = np.where(inner, self.down[at, right.astype(int)], at)
        return self.cell[at]

    def calls(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell whose region the radius of a row may reach."""
        found = [np.zeros((2, 0), int)]
        step = max(1, (1 << 20) // len(self.lo))
        for i in range(0, len(x), step):
            near = gaps(x[i:i + step], self.lo, self.hi) <= (radius[i:i + step] ** 2 * (1 + SLACK))[:, None]
            found.append(np.stack(np.nonzero(near)) + [[i], [0]])
        return tuple(np.concatenate(found, axis=1))


def cut(sample: np.ndarray, wanted: int) -> Cells:
    dim, split, down, cell, lo, hi = [], [], [], [], [], []

    def node(x: np.ndarray, many: int, low: np.ndarray, high: np.ndarray) -> int:
        i = len(dim)
        dim.append(-1), split.append(0.0), down.append((i, i)), cell.append(-1)
        spread = np.nan_to_num(x.std(axis=0), nan=0.0, posinf=0.0) if many > 1 and len(x) > 1 else np.zeros(1)
        d = int(spread.argmax()) if spread.size else 0
        if not spread.size or not spread[d] > 0:
            cell[i] = len(lo)
            lo.append(low), hi.append(high)
            return i
        y = np.sort(x[:, d])
        s = y[len(y) * (many // 2) // many]
        s = s if s > y[0] else y[np.searchsorted(y, s, "right")]  # equal values stay together
        left = x[:, d] < s
        few = int(min(many - 1, max(1, round(many * left.mean()))))
        dim[i], split[i] = d, s
        to, fro = high.copy(), low.copy()
        to[d] = fro[d] = s
        down[i] = node(x[left], few, low, to), node(x[~left], many - few, fro, high)
        return i

    width = sample.shape[1]
    with np.errstate(invalid="ignore", over="ignore"):
        node(sample, wanted, np.full(width, -np.inf), np.full(width, np.inf))
    return Cells(*map(np.array, (dim, split, down, cell, lo, hi)))


def cell_size(n: int, dims: int, cores: int) -> int:
    """Points of a cell: few cells, since points are sent to each that they ask at, but enough pairs of them for all cores."""
    return max(1, min(CELL, max(64, VALUES // max(1, dims)), max(CELL_LEAST, int(n / (4 * cores) ** 0.5) + 1)))


def placed(points: DataFrame, block: int | None = None) -> tuple[Cells, DataFrame, int]:
    """The cells of ``points`` (pid, x, ...), the points with ``cell``, and how many a cell is to hold."""
    spark = points.sparkSession
    n, dims = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    block = block or cell_size(n, dims, spark.sparkContext.defaultParallelism)
    wanted = -(-n // block)
    share = min(1.0, max(SAMPLED_LEAST, SAMPLED * wanted) / max(n, 1))
    drawn = points.where(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("x")
    sample = vectors(drawn.toArrow()["x"]) if wanted > 1 else np.zeros((0, dims))  # SAMPLED points per cell
    cells = cut(sample, wanted)
    sent = spark.sparkContext.broadcast(cells)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                at = sent.value.of(vectors(batch.column("x")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "cell"])

    if len(cells.lo) == 1:
        return cells, points.withColumn("cell", F.lit(0)), block
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return cells, points.mapInArrow(place, f"{schema}, cell int"), block


def met(points: DataFrame, guests: DataFrame, compare, schema: str, block: int) -> DataFrame:
    """``compare(guests, points)`` (Arrow tables) for every cell and up to about ``block`` of the guests that ask at it."""
    spark = points.sparkSession
    sizes = [(r.cell, -(-r["count"] // block)) for r in guests.groupBy("cell").count().collect()]  # a row per cell
    blocks = F.broadcast(spark.createDataFrame(sizes, "cell int, blocks int"))
    g = guests.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("pid"), "blocks").cast("int")).drop("blocks")
    h = points.join(blocks, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    nothing = spark.createDataFrame([], schema).toArrow()

    def task(visitors: pa.Table, residents: pa.Table) -> pa.Table:
        if not visitors.num_rows or not residents.num_rows:
            return nothing
        return compare(visitors, residents)

    g = g.toDF(*g.columns)  # both sides may come from one frame
    return g.groupBy("cell", "part").cogroup(h.groupBy("cell", "part")).applyInArrow(task, schema)


# ------------------------------------------------------------------ inside a task
def gaps(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of rows to boxes."""
    out = np.zeros((len(x), len(lo)))
    with np.errstate(invalid="ignore", over="ignore"):
        for d in range(x.shape[1]):
            if np.isinf(lo[:, d]).all() and np.isinf(hi[:, d]).all():
                continue
            y = x[:, d, None]
            gap = np.fmax(np.fmax(lo[None, :, d] - y, y - hi[None, :, d]), 0.0)
            out += gap * gap
    return out


def leaf_order(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where each leaf starts in it (and the end)."""
    order, starts, todo = np.arange(len(x)), [len(x)], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            starts.append(a)
            continue
        y, half = x[order[a:b]], (b - a) // 2
        with np.errstate(invalid="ignore"):
            d = int(np.nan_to_num(y.max(axis=0) - y.min(axis=0), posinf=0.0).argmax()) if y.shape[1] else 0
        order[a:b] = order[a:b][np.argpartition(y[:, d], half)] if y.shape[1] else order[a:b]
        todo += [(a, a + half), (a + half, b)]
    return order, np.unique(starts)


class Leaves:
    """The points of a cell in leaves."""

    def __init__(self, x: np.ndarray, size: int = LEAF):
        self.order, self.starts = leaf_order(x, max(1, size))  # leaf b: order[starts[b]:starts[b + 1]]
        self.x = x[self.order]
        self.lo, self.hi = (f.reduceat(self.x, self.starts[:-1], axis=0) for f in (np.minimum, np.maximum))
        middle = self.x.mean(axis=0)
        self.middle = np.where(np.isfinite(middle), middle, 0.0)
        y = self.x - self.middle
        self.norm = (y * y).sum(axis=1)
        self.product = np.concatenate([-2 * y, self.norm[:, None]], axis=1)
        finite = self.norm[np.isfinite(self.norm)]
        self.far = float(np.sqrt(finite.max(initial=0.0)))

    def asking(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``product`` is multiplied with; the squared length of each row; the rounding error of its squared distances."""
        y = x - self.middle
        norm = (y * y).sum(axis=1)
        error = ROUNDING * (8 + x.shape[1]) * (np.sqrt(norm) + self.far) ** 2
        return np.concatenate([y, np.ones((len(x), 1))], axis=1), norm, error

    def distances(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact distances of pairs (row of ``x``, place in order)."""
        out, step = np.empty(len(row)), max(1, (1 << 21) // max(1, x.shape[1]))
        for i in range(0, len(row), step):
            out[i:i + step] = np.sqrt(((x[row[i:i + step]] - self.x[at[i:i + step]]) ** 2).sum(axis=1))
        return out

    def nearest(self, pid: np.ndarray, x: np.ndarray, k: int, radius: np.ndarray, own: np.ndarray, piece: int = LEAF):
        """(row, place, distance) of the k nearest points within ``radius`` of each row, the point of its own ``pid`` left out.

        Sorted by row, then by distance and ``own``, the points' ids by place; rows that lie close should follow each other.
        """
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for i in range(0, len(x), piece):
            row, at, d = self._piece(pid[i:i + piece], x[i:i + piece], k, radius[i:i + piece].copy(), own)
            found.append((row + i, at, d))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _piece(self, pid, x, k, radius, own):
        left, norm, error = self.asking(x)
        reach = gaps(x, self.lo, self.hi)
        held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        waiting, many = [], 0

        def settled(held):
            """Exact distances of what waits; of all, the k nearest per row stay and narrow its radius."""
            row, at = (np.concatenate(c) for c in zip(*waiting, strict=True))
            d = self.distances(x, row, at)
            good = np.isfinite(d) & (own[at] != pid[row]) & (d <= radius[row])
            row, at, d = (np.concatenate([a, b[good]]) for a, b in zip(held, (row, at, d), strict=True))
            order = np.lexsort((own[at], d, row))
            row, at, d = row[order], at[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == k - 1
            radius[row[last]] = d[last]
            return row[place < k], at[place < k], d[place < k]

        for n, leaf in enumerate(np.argsort(reach.min(axis=0), kind="stable").tolist()):
            limit = radius * radius * (1 + SLACK)
            rows = np.flatnonzero(reach[:, leaf] <= limit)
            if not len(rows):
                continue
            a, b = self.starts[leaf], self.starts[leaf + 1]
            with np.errstate(invalid="ignore", over="ignore"):
                hit = left[rows] @ self.product[a:b].T <= (limit + error - norm)[rows, None]
            r, c = np.nonzero(hit)
            waiting.append((rows[r], c + a))
            many += len(r)
            if n == 0 or many > PENDING * k * len(x) or not np.isfinite(radius[rows]).all():
                held, waiting, many = settled(held), [], 0
        return settled(held) if waiting else held

    def within(self, x: np.ndarray, radius: float, piece: int = LEAF):
        """For pieces of ``x`` and the leaves they may reach: (rows, first and last place of the leaf, near), near a table of truth values."""
        for i in range(0, len(x), piece):
            y = x[i:i + piece]
            left, norm, error = self.asking(y)
            reach = gaps(y, self.lo, self.hi) <= radius * radius * (1 + SLACK)
            for leaf in np.flatnonzero(reach.any(axis=0)).tolist():
                rows = np.flatnonzero(reach[:, leaf])
                a, b = self.starts[leaf], self.starts[leaf + 1]
                with np.errstate(invalid="ignore", over="ignore"):
                    d2 = left[rows] @ self.product[a:b].T + norm[rows, None]
                    far = radius * radius * (1 + SLACK) + error[rows, None]
                    near = d2 <= radius * radius * (1 - SLACK) - error[rows, None]
                    r, c = np.nonzero((d2 <= far) & ~near)
                near[r, c] = self.distances(y, rows[r], c + a) <= radius
                yield rows + i, a, b, near
