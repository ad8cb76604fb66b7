"""Co-moments of all pairs of numeric columns in one scan, whatever the number of pairs.

A task turns its rows into a masked matrix and takes, by matrix products, for every pair of columns
the count, both means and the three second moments over the rows that hold both.  Batches and tasks
are merged by the rule for partial moments (Chan et al. 1983), which does not cancel: a batch is
centred first, and a column that is constant over the rows counted has moments of exactly zero.

Columns come in blocks of WIDTH; a task holds six WIDTH x WIDTH tables per pair of blocks, and a scan
takes at most PAIRS pairs of blocks, so memory is bounded at any width (one scan up to 4 x WIDTH
columns).  What a task sends is its tables, not its rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chunks, q

WIDTH = 512       # columns of a block
PAIRS = 10        # pairs of blocks of one scan
CELLS = 1 << 21   # numbers of a matrix taken at once
ZERO = 1e-13      # a second moment below this share of its uncentred sum is rounding
NAMES = ("n", "ma", "mb", "aa", "bb", "ab")
_LISTS = ", ".join(f"{c} array<double>" for c in NAMES)


def merged(a: dict, b: dict) -> dict:
    """The moments of two sets of rows together; the arrays of a side with n = 0 count for nothing."""
    n = a["n"] + b["n"]
    with np.errstate(all="ignore"):
        share = np.where(n > 0, b["n"] / n, 0.0)
        da = np.where(b["n"] > 0, b["ma"] - a["ma"], 0.0)
        db = np.where(b["n"] > 0, b["mb"] - a["mb"], 0.0)
        weight = a["n"] * share
        return {"n": n, "ma": a["ma"] + da * share, "mb": a["mb"] + db * share, "aa": a["aa"] + b["aa"] + da * da * weight,
                "bb": a["bb"] + b["bb"] + db * db * weight, "ab": a["ab"] + b["ab"] + da * db * weight}


def _moments(x: np.ndarray, y: np.ndarray) -> dict:
    """Moments of every column of ``x`` with every column of ``y`` (NaN is missing)."""
    def parts(v):
        there = ~np.isnan(v)
        some = there.any(axis=0)
        first = v[there.argmax(axis=0), np.arange(v.shape[1])]
        mean = np.where(there, v, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        constant = np.where(there, v == first, True).all(axis=0)
        pivot = np.where(some, np.where(constant, first, mean), 0.0)
        return np.where(there, v - pivot, 0.0), there.astype(float), pivot

    with np.errstate(all="ignore"):
        (a, here_a, pivot_a), (b, here_b, pivot_b) = parts(x), parts(y)
        n = here_a.T @ here_b
        of = np.maximum(n, 1)
        sa, sb = a.T @ here_b, here_a.T @ b
        raw_a, raw_b = (a * a).T @ here_b, here_a.T @ (b * b)
        aa, bb = raw_a - sa * sa / of, raw_b - sb * sb / of
        return {"n": n, "ma": np.where(n > 0, pivot_a[:, None] + sa / of, 0.0), "mb": np.where(n > 0, pivot_b[None] + sb / of, 0.0),
                "aa": np.where(aa > ZERO * raw_a, aa, np.where(np.isnan(aa), aa, 0.0)),
                "bb": np.where(bb > ZERO * raw_b, bb, np.where(np.isnan(bb), bb, 0.0)), "ab": a.T @ b - sa * sb / of}


def _scan(blocks: list[tuple[int, int]], pairs: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict] = {}
        for batch in batches:
            step = max(1, CELLS // max(1, batch.num_columns))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float, copy=False)
                for i, j in pairs:
                    now = _moments(x[:, slice(*blocks[i])], x[:, slice(*blocks[j])])
                    held[i, j] = merged(held[i, j], now) if (i, j) in held else now
        for (i, j), table in held.items():
            for row in range(blocks[i][1] - blocks[i][0]):
                lists = [pa.array([table[c][row]], pa.list_(pa.float64())) for c in NAMES]
                yield pa.RecordBatch.from_arrays([pa.array([blocks[i][0] + row], pa.int32()), pa.array([blocks[j][0]], pa.int32()), *lists],
                                                 ["a", "first", *NAMES])

    return run


def _together(frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for row in frame.itertuples():
        now = {c: np.asarray(getattr(row, c), float) for c in NAMES}
        total = now if total is None else merged(total, now)
    return pd.DataFrame({"a": [frame.a.iloc[0]], "first": [frame["first"].iloc[0]], **{c: [total[c].tolist()] for c in NAMES}})


def comoments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, ma, mb, aa, bb, ab) for positions a <= b of ``columns``: rows that hold both, their
    means, and sums of squared and crossed deviations.  Null and NaN are missing."""
    edges = [(i, min(i + WIDTH, len(columns))) for i in range(0, len(columns), WIDTH)]
    pairs = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]
    out = None
    for some in chunks(pairs, PAIRS):
        used = sorted({i for p in some for i in p})
        place = {b: k for k, b in enumerate(used)}
        names = [c for b in used for c in columns[slice(*edges[b])]]
        local, at = [], 0
        for b in used:
            local.append((at, at + edges[b][1] - edges[b][0]))
            at = local[-1][1]
        numbers = df.select(*[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
        tables = numbers.mapInArrow(_scan(local, [(place[i], place[j]) for i, j in some]), f"a int, first int, {_LISTS}")
        rows = tables.groupBy("a", "first").applyInPandas(_together, f"a int, first int, {_LISTS}")
        cells = rows.select("a", "first", F.posexplode(F.arrays_zip(*NAMES)).alias("k", "m"))
        back = F.array(*[F.lit(columns.index(c)) for c in names])  # position among all columns
        part = cells.select(F.get(back, F.col("a")).alias("a"), F.get(back, F.col("first") + F.col("k")).alias("b"), "m.*")
        part = part.where("a <= b")
        out = part if out is None else out.unionByName(part)
    return out
