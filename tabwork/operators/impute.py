"""Filling missing numbers from the nearest rows (survey §2.7, ``clean_knn_impute``).

The distance of two rows is taken over the columns that both hold, each divided by its range: the sum of
squared differences times the number of columns over the number shared.  A donor must hold the wanted
column.  The value is the mean over the k nearest donors, every donor that ties with the k-th included, so
it depends neither on the order of rows nor on ids.

Equal rows are one donor with a multiplicity, and ask once.  Donors that hold the same columns are cut into cells
(``cells``) over the columns they hold; a cell or a leaf in it is passed over when its box, over the columns
that a query shares with it, is farther than the k-th donor found so far.  So no donor is copied for the ways in which
other rows miss columns.  A query first meets one cell of the most frequent kind of donor, which bounds its k-th
distance, and then only the cells that may hold something as near.

Where rows miss columns in more than PATTERNS ways there are no cells: each wanted column is one node, and asking
rows and donors are compared in blocks.  Both ways give the same values.

Defined cases: NaN counts as missing; a row that shares no column with any donor (also one that holds
nothing) gets the median of the column, within its group if ``group_by`` names columns and the group holds a
value; a column without any value stays null; whole-number columns get the nearest whole number; fewer
than k donors are all used; a column of one value adds nothing to a distance; repeated rows are
filled alike; other columns pass through; an empty table stays empty.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, numeric_columns
from ..functions.quantiles import quantiles_long
from . import cells as C
from . import metric_tree as M
from .cells import saved
from .metric_tree import kept

PATTERNS = 64     # ways to miss columns that get cells of their own
BLOCK = 1024      # points on either side of a comparison without cells
PIECE = 256       # queries that are compared with a leaf at a time
DECIMALS = 9      # squared distances are rounded to these, so that ties do not depend on rounding
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _parts(d2: np.ndarray, m: np.ndarray, s: np.ndarray, k: int):
    """The least distances until k donors, ties whole: (d2, donors, sum)."""
    values, at = np.unique(d2, return_inverse=True)
    many, total = np.bincount(at, m, len(values)), np.bincount(at, s, len(values))
    last = int(np.searchsorted(np.cumsum(many), k)) + 1
    return values[:last], many[:last], total[:last]


def _nearest(distances, k: int):
    """Per visiting query of a leaf, the least distances to the residents."""
    def compare(g: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        d2, m, s = distances(g, h), h.m.to_numpy(float), h.s.to_numpy(float)
        out = []
        for i, pid in enumerate(g.pid.to_numpy()):
            met = np.isfinite(d2[i])
            if met.any():
                values, many, total = _parts(d2[i, met], m[met], s[met], k)
                out.append(pd.DataFrame({"pid": pid, "d2": values, "m": many.astype("int64"), "s": total}))
        return pd.concat(out) if out else pd.DataFrame({"pid": [], "d2": [], "m": [], "s": []})

    return compare


def _shared(g: pd.DataFrame, h: pd.DataFrame) -> np.ndarray:
    """Squared distances over shared coordinates (NaN is missing), infinite where none is shared."""
    x, y = np.array(g.x.tolist(), float), np.array(h.x.tolist(), float)
    total, many = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap = (x[:, j, None] - y[None, :, j]) ** 2
        both = ~np.isnan(gap)
        total += np.where(both, gap, 0.0)
        many += both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(many > 0, np.round(total * (x.shape[1] / many), DECIMALS), np.inf)


_FOUND = "pid long, d2 double, m long, s double"


class _Donors:
    """The cells of donors that hold the same columns: ``held`` (places), planes over them and the number of the first cell."""

    def __init__(self, mask: int, width: int, cells: C.Cells, first: int):
        self.mask, self.cells, self.first = mask, cells, first
        self.held = [j for j in range(width) if mask >> j & 1]

    def bounds(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least squared distances of rows of ``x`` (NaN is missing) to boxes over the held columns, infinite where none is shared."""
        out, many = np.zeros((len(x), len(lo))), np.zeros(len(x))
        for i, j in enumerate(self.held):
            shared = ~np.isnan(x[:, j])
            out[shared] += C.gaps(x[shared, j, None], lo[:, i, None], hi[:, i, None])
            many += shared
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(many[:, None] > 0, out * (x.shape[1] / many)[:, None], np.inf)


def _until_whole(row: np.ndarray, d2: np.ndarray, m: np.ndarray, s: np.ndarray, k: int):
    """Per row the least distances until k donors, ties whole, donors of one distance added up: sorted (row, d2, donors, sum, donors before)."""
    order = np.lexsort((d2, row))
    row, d2, m, s = row[order], d2[order], m[order], s[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (d2[1:] != d2[:-1])][:len(row)])
    if len(first):
        row, d2, m, s = row[first], d2[first], np.add.reduceat(m, first), np.add.reduceat(s, first)
    before = np.cumsum(m) - m
    before -= before[np.searchsorted(row, row)]
    near = before < k
    return row[near], d2[near], m[near], s[near], before[near]


def _nearest_donors(x, wanted, bound, donors: _Donors, y, m, raw, k: int, leaf: int):
    """(row, d2, donors, sum) of the least distances from queries ``x`` to the donors ``y`` of a cell, none beyond ``bound``."""
    order, starts = C.leaf_order(y[:, donors.held], leaf)
    y, m, raw = y[order], m[order], raw[order]
    lo, hi = (f.reduceat(y[:, donors.held], starts[:-1], axis=0) for f in (np.minimum, np.maximum))
    out = []
    for i in range(0, len(x), PIECE):
        g, c, limit = x[i:i + PIECE], wanted[i:i + PIECE], bound[i:i + PIECE].copy()
        least = donors.bounds(g, lo, hi)
        shared = ~np.isnan(g)
        at_zero, many = np.where(shared, g, 0.0), shared[:, donors.held].sum(axis=1)
        found = tuple(np.zeros(0, t) for t in (int, float, float, np.longdouble))
        for b in np.argsort(least.min(axis=0), kind="stable").tolist():
            rows = np.flatnonzero((least[:, b] <= limit + 10.0 ** -DECIMALS) & (many > 0))
            if not len(rows):
                continue
            here = slice(starts[b], starts[b + 1])
            total = np.zeros((len(rows), starts[b + 1] - starts[b]))
            for j in donors.held:
                gap = (at_zero[rows, j, None] - y[None, here, j]) * shared[rows, j, None]
                total += gap * gap
            d2 = np.round(total * (x.shape[1] / many[rows])[:, None], DECIMALS)
            r, at = np.nonzero(d2 <= limit[rows, None])
            w = m[here][at]
            new = rows[r], d2[r, at], w, w * raw[here][at, c[rows[r]]].astype(np.longdouble)
            *found, before = _until_whole(*(np.concatenate(f) for f in zip(found, new, strict=True)), k)
            enough = before + found[2] >= k
            limit[found[0][enough]] = found[1][enough]
        out.append((found[0] + i, *found[1:]))
    return tuple(np.concatenate(f) for f in zip(*out, strict=True))


def _searched_in_cells(points: DataFrame, masks: list[int], wanted: list[int], spans: list[float], k: int, leaf: int, block: int | None) -> DataFrame:
    """(pid, d2, m, s): donors nearest to each point (pid, mask, x, m) and wanted column that it misses."""
    spark, width = points.sparkSession, len(spans)
    scale = np.array([s if s else 1.0 for s in spans])
    full = (1 << width) - 1
    sizes = {r["mask"]: r["count"] for r in points.groupBy("mask").count().collect()}  # at most PATTERNS
    block = block or C.cell_size(sum(sizes.values()), width, spark.sparkContext.defaultParallelism)
    cells = {mask: -(-n // block) for mask, n in sizes.items()}
    share = {mask: int(min(1.0, max(C.SAMPLED_LEAST, C.SAMPLED * cells[mask]) / n) * (1 << 30)) for mask, n in sizes.items() if cells[mask] > 1}
    drawn = {mask: [] for mask in sizes}
    if share:
        below = F.create_map(*[F.lit(v) for mask, n in share.items() for v in (mask, n)])[F.col("mask")]
        sample = points.where(F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) <= below).select("mask", "x").toArrow()  # SAMPLED points per cell
        x, of = C.vectors(sample["x"]) / scale, sample["mask"].to_numpy()
        drawn = {mask: x[of == mask] for mask in sizes}
    kinds, first = [], 0
    for mask in sorted(sizes, key=lambda mask: (-sizes[mask], mask)):
        held = [j for j in range(width) if mask >> j & 1]
        planes = C.cut(drawn[mask][:, held] if mask in share else np.zeros((0, len(held))), cells[mask])
        kinds.append(_Donors(mask, width, planes, first))
        first += len(planes.lo)
    sent = spark.sparkContext.broadcast(kinds)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x, of, cell = C.vectors(batch.column("x")) / scale, batch.column("mask").to_numpy(), np.zeros(batch.num_rows, int)
                for kind in sent.value:
                    mine = np.flatnonzero(of == kind.mask)
                    cell[mine] = kind.first + kind.cells.of(x[np.ix_(mine, kind.held)])
                yield pa.RecordBatch.from_arrays([batch.column("mask"), batch.column("x"), batch.column("m"), pa.array(cell, pa.int32())], ["mask", "x", "m", "cell"])

    donors = saved(points.select("mask", "x", "m").mapInArrow(place, "mask long, x array<double>, m long, cell int"))
    ask = F.explode(F.array(*[F.lit(c) for c in wanted])).alias("c")
    asked = (points.where(F.col("mask") != full).select("pid", "mask", "x", ask).where(F.expr("(shiftright(mask, c) & 1) = 0"))
             .select((F.col("pid") * width + F.col("c")).alias("pid"), "mask", "x", "c"))

    def bounds(mask: int, c: int, x: np.ndarray):
        """The donors that rows of ``mask`` may ask for column ``c``, and the least distances to their cells."""
        for kind in sent.value:
            if kind.mask >> c & 1 and kind.mask & mask:
                yield kind, kind.bounds(x, kind.cells.lo, kind.cells.hi)

    def groups(batch):
        """The rows of a batch by what they miss and ask for."""
        x, of, c = C.vectors(batch.column("x")) / scale, batch.column("mask").to_numpy(), batch.column("c").to_numpy()
        key = of * width + c
        for one in np.unique(key).tolist():
            rows = np.flatnonzero(key == one)
            yield rows, one // width, one % width, x[rows]

    def homes(batches):
        for batch in batches:
            home = np.full(batch.num_rows, -1)
            for rows, mask, c, x in groups(batch) if batch.num_rows else ():
                for kind, least in bounds(mask, c, x):  # the most frequent kind comes first
                    equal = np.cumsum(least == least.min(axis=1)[:, None], axis=1)
                    turn = batch.column("pid").to_numpy()[rows] // width % equal[:, -1]  # cells that are equally near take turns
                    home[rows] = kind.first + (equal > turn[:, None]).argmax(axis=1)
                    break
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(np.full(len(home), np.inf))], [*batch.schema.names, "cell", "kth"])

    def compare(g: pa.Table, h: pa.Table) -> pa.Table:
        kind = next(kind for kind in sent.value if kind.mask == h["mask"][0].as_py())
        x, raw = C.vectors(g["x"]) / scale, C.vectors(h["x"])
        order, _ = C.leaf_order(np.nan_to_num(np.column_stack([x, g["mask"].to_numpy()])), PIECE)  # those that lie close together
        x, g = x[order], g.take(pa.array(order))
        row, d2, m, s = _nearest_donors(x, g["c"].to_numpy(), g["kth"].to_numpy(), kind, raw / scale, h["m"].to_numpy().astype(float), raw, k, leaf)
        return pa.table({"pid": g["pid"].take(pa.array(row)), "d2": pa.array(d2), "m": pa.array(np.rint(m).astype("int64")), "s": pa.array(s.astype(float))})

    asked = saved(asked.mapInArrow(homes, "pid long, mask long, x array<double>, c int, cell int, kth double").where("cell >= 0"))
    found = saved(C.met(donors, asked, compare, _FOUND, block))

    def others(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            home, kth = batch.column("cell").to_numpy(), batch.column("kth").to_numpy()
            calls = [(np.zeros(0, int), np.zeros(0, int))]
            for rows, mask, c, x in groups(batch):
                for kind, least in bounds(mask, c, x):
                    r, cell = np.nonzero(least <= kth[rows, None] + 10.0 ** -DECIMALS)
                    calls.append((rows[r], kind.first + cell))
            row, cell = (np.concatenate(c) for c in zip(*calls, strict=True))
            away = cell != home[row]
            out = batch.drop_columns(["cell"]).take(pa.array(row[away]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell[away], pa.int32())], [*out.schema.names, "cell"])

    bounded = asked.drop("kth").join(_kth(found, k), "pid", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    guests = saved(bounded.mapInArrow(others, "pid long, mask long, x array<double>, c int, kth double, cell int"))
    return found.unionByName(C.met(donors, guests, compare, _FOUND, block))


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(pid, kth): the squared distance of the k-th donor found, where there are so many."""
    near = _until(found, k)
    return near.groupBy("pid").agg(F.sum("m").alias("n"), F.max("d2").alias("kth")).where(F.col("n") >= k).select("pid", "kth")


def _total(column: str):
    """The sum of few numbers, with the rounding of each step added back: it does not depend on how donors are dealt."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lost"))

    def step(a, x):
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["lost"] + lost).alias("lost"))

    return F.aggregate(F.sort_array(F.collect_list(column)), start, step, lambda a: a["s"] + a["lost"])


def _until(found: DataFrame, k: int) -> DataFrame:
    """The least distances of each query until k donors, ties whole.  A query has at most k rows per leaf it visited."""
    each = found.groupBy("pid", "d2").agg(F.sum("m").alias("m"), _total("s").alias("s"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("pid").orderBy("d2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("before", before).where(F.col("before") < k)


def _searched_in_blocks(rows: DataFrame, wanted: list[int], width: int, k: int, block: int) -> DataFrame:
    x = F.transform("v", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x")
    each = F.explode(F.array(*[F.lit(c) for c in wanted]))
    held = (F.expr("shiftright(mask, c)").bitwiseAND(F.lit(1))) == 1
    rows = rows.select("row", "raw", "mask", x, each.alias("c")).withColumn("node", F.col("c").cast("string"))
    donors = rows.where(held).groupBy("node", "x").agg(F.count(F.lit(1)).alias("m"), F.sum(F.expr("raw[c]")).alias("s"))
    donors = kept(donors.withColumn("pid", F.xxhash64("x")))
    queries = kept(rows.where(~held).select((F.col("row") * width + F.col("c")).alias("pid"), "x", "node"))
    return M.compared(donors, queries, _nearest(_shared, k), _FOUND, block)


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    long = rows.select(*keys, F.posexplode("raw").alias("c", "value"))
    return quantiles_long(long, [*keys, "c"], "value", [0.5]).select(*keys, "c", F.col("value").alias("median"))


def knn_impute(df: DataFrame, columns: list[str] | None = None, k: int = 5, wanted: list[str] | None = None,
               group_by: list[str] = (), leaf: int = C.LEAF, block: int | None = None, patterns: int = PATTERNS) -> DataFrame:
    """``df`` with every null of ``wanted`` (by default all of ``columns``, by default the numeric ones) filled."""
    columns = list(columns or [c for c in numeric_columns(df) if c not in group_by])
    wanted = list(columns if wanted is None else wanted)
    if set(wanted) - set(columns):
        columns += [c for c in wanted if c not in columns]
    if not wanted:
        return df
    width, places = len(columns), [columns.index(c) for c in wanted]
    if width > 62:
        raise ValueError("at most 62 columns take part in a distance: name them in columns")
    plain = [f"_c{i}" for i in range(len(df.columns))]
    of = dict(zip(df.columns, plain, strict=True))
    whole = kept(nan_to_null(df).toDF(*plain).withColumn("_row", F.monotonically_increasing_id()))
    value = [F.col(of[c]).cast("double") for c in columns]
    ends = whole.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(value) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    spans = [(ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0) for i in range(width)]
    mask = sum((F.when(v.isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, v in enumerate(value)), F.lit(0).cast("long"))
    keys = [of[c] for c in group_by]
    rows = whole.select(F.col("_row").alias("row"), mask.alias("mask"), *keys, F.array(*value).alias("raw"),
                        F.array(*[v / (s if s else 1.0) for v, s in zip(value, spans, strict=True)]).alias("v"))
    masks = [r[0] for r in rows.select("mask").distinct().limit(patterns + 1).collect()]
    open_bits = sum(1 << p for p in places)
    if all(m & open_bits == open_bits for m in masks):
        return df
    if len(masks) <= patterns:
        x = F.transform("raw", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x")
        points = saved(rows.groupBy("mask", x).agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("pid")))
        found = _searched_in_cells(points, sorted(masks), places, spans, k, leaf, block)
        lacking = F.col("mask") != (1 << width) - 1
        alike = rows.where(lacking).select("row", "mask", x).join(points.where(lacking).select("mask", "x", "pid"), ["mask", "x"]).select("row", "pid")
    else:
        found = _searched_in_blocks(rows, places, width, k, block or BLOCK)
        alike = None
    near = _until(found, k).groupBy("pid").agg((_total("s") / F.sum("m")).alias("value"))
    near = near.select(F.expr(f"pid div {width}").alias("_row"), F.pmod("pid", F.lit(width)).alias("c"), "value")
    filled = near.groupBy("_row").agg(*[F.max(F.when(F.col("c") == p, F.col("value"))).alias(f"_k{p}") for p in places])
    if alike is not None:
        filled = alike.join(filled.withColumnRenamed("_row", "pid"), "pid").drop("pid").withColumnRenamed("row", "_row")
    out = whole.join(filled, "_row", "left")
    medians = {r.c: r.median for r in _medians(rows, []).collect()}  # a row per column
    if keys:
        of_group = _medians(rows, keys).groupBy(*keys).agg(
            *[F.max(F.when(F.col("c") == p, F.col("median"))).alias(f"_m{p}") for p in places])
        of_group = of_group.toDF(*[f"_g{i}" for i in range(len(keys))], *of_group.columns[len(keys):])
        out = out.join(of_group, [F.col(a).eqNullSafe(F.col(f"_g{i}")) for i, a in enumerate(keys)], "left")
    final = []
    for c in df.columns:
        col = F.col(of[c])
        if c in wanted:
            p, kind = columns.index(c), df.schema[c].dataType.simpleString()
            guess = F.coalesce(F.col(f"_k{p}"), *([F.col(f"_m{p}")] if keys else []), F.lit(medians.get(p)).cast("double"))
            col = F.coalesce(col, (F.round(guess) if kind in WHOLE else guess).cast(kind))
        final.append(col.alias(c))
    return out.select(*final)
