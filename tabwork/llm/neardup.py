"""Embedding near-duplicates: spherical k-means cells and blocked cosine products within cells.

Centres are fitted on a bounded sample (SAMPLE vectors); every vector is then placed in the cell of
its nearest centre, and also visits each cell whose boundary is closer than a margin.  Two vectors
with cosine >= c lie at most d = sqrt(2 - 2c) apart, so of a linked pair parted by a boundary one is
within d/2 of it: with margin d/2 no link is lost, in any number of dimensions.

Equal vectors of a label are one class before the search.  Inside a cell and label, classes are dealt to
blocks of about BLOCK, and a task multiplies one block by another, so a dense cell is many tasks.
A task returns a count per class and links to one member per group found, never all its pairs.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, and any
vector with a null label, links with nothing; vectors of different length do not link; rows of equal
id are separate vectors; null ids never name a component unless all ids of it are null; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, saved, table
from .components import components

COSINE = 0.93
SAMPLE = 20_000     # vectors the centres are fitted on
PER_CELL = 1024     # vectors a cell should hold
CELLS = 4096        # most centres; denser cells are split into blocks
BLOCK = 1024        # classes on either side of one product
SEED = 7


def margin(cosine: float) -> float:
    """Half the distance of the farthest linked vectors, rounding allowed for."""
    return float(np.sqrt(2 - 2 * cosine) / 2 + 1e-9)


def _centres(classes: DataFrame, n: int) -> np.ndarray:
    """Unit centres by spherical k-means on a sample of the classes chosen by hash."""
    cells = int(min(CELLS, max(1, n // PER_CELL)))
    sample = classes.orderBy(F.xxhash64("node", F.lit(SEED))).limit(SAMPLE)
    # k-means needs at least two cells; one cell needs no centre
    if cells < 2:
        return np.zeros((1, 1))
    points = sample.select(array_to_vector("vec").alias("features")).persist()
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=10, seed=SEED).fit(points)
    points.unpersist()
    centres = np.array(model.clusterCenters(), float)
    norms = np.linalg.norm(centres, axis=1)
    return centres[norms > 0] / norms[norms > 0, None]


def _placed(classes: DataFrame, centres: np.ndarray, reach: float) -> DataFrame:
    """Every class with its home cell and the cells it visits."""
    sent = classes.sparkSession.sparkContext.broadcast(centres)
    names = ["node", "label", "n", "vec", "home", "visits"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = sent.value
        apart = np.sqrt(np.maximum(2 - 2 * middle @ middle.T, 0)) if len(middle) > 1 else None
        for batch in batches:
            homes, visits = np.zeros(batch.num_rows, np.int32), [[]] * batch.num_rows
            if apart is not None and batch.num_rows:
                x = np.array(batch.column(3).flatten(), float).reshape(batch.num_rows, -1)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i in range(0, len(x), 2048):
                    near = x[i:i + 2048] @ middle.T
                    home = near.argmax(axis=1)
                    homes[i:i + 2048] = home
                    gap = near[np.arange(len(home)), home][:, None] - near
                    seen = gap <= reach * apart[home]
                    seen[np.arange(len(home)), home] = False
                    visits[i:i + 2048] = [np.flatnonzero(s).tolist() for s in seen]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes), pa.array(visits, pa.list_(pa.int32()))], names)

    return classes.mapInArrow(place, "node long, label string, n long, vec array<double>, home int, visits array<int>")


def _forest(found: np.ndarray) -> np.ndarray:
    """For every row and then column of a boolean matrix, the least row of its linked group, or -1."""
    rows, columns = found.shape
    group = np.full(rows + columns, -1)
    for r in np.flatnonzero(found.any(axis=1)):
        if group[r] >= 0:
            continue
        new_rows = np.array([r])
        group[r] = r
        while len(new_rows):
            new_columns = np.flatnonzero(found[new_rows].any(axis=0) & (group[rows:] < 0))
            group[rows + new_columns] = r
            new_rows = np.flatnonzero(found[:, new_columns].any(axis=1) & (group[:rows] < 0))
            group[new_rows] = r
    return group


def _products(cosine: float):
    def multiply(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell = key[0]
        homes, guests = frame[frame.role == 0], frame[frame.role == 1]
        if not len(homes) or not len(guests):
            return pd.DataFrame({"node": [], "links": [], "to": []})
        raw_h, raw_g = np.stack(homes.vec.to_numpy()), np.stack(guests.vec.to_numpy())
        norm_h, norm_g = np.linalg.norm(raw_h, axis=1), np.linalg.norm(raw_g, axis=1)
        score = (raw_g / norm_g[:, None]) @ (raw_h / norm_h[:, None]).T
        for g, h in zip(*np.nonzero(np.abs(score - cosine) < 1e-9), strict=True):  # decided without rounding the vectors
            score[g, h] = np.dot(raw_g[g], raw_h[h]) / (norm_g[g] * norm_h[h])
        found = score >= cosine
        from_, ids_g, ids_h = guests.home.to_numpy(), guests.node.to_numpy(), homes.node.to_numpy()
        # a pair within the cell is taken once; a pair that meets in two cells is taken in the lesser
        found &= (from_[:, None] != cell) | (ids_g[:, None] < ids_h[None, :])
        if (from_ > cell).sum() < len(from_):
            cells = {c: i for i, c in enumerate(np.unique(from_))}
            back = np.zeros((len(cells), len(homes)), bool)
            for h, seen in enumerate(homes.visits):
                for c in seen:
                    if c in cells:
                        back[cells[c], h] = True
            found &= ~((from_ < cell)[:, None] & back[[cells[c] for c in from_]])
        weight_h, weight_g = homes.n.to_numpy(), guests.n.to_numpy()
        group, all_ids = _forest(found), np.concatenate([ids_g, ids_h])
        links = np.concatenate([found @ weight_h, weight_g @ found])
        has = group >= 0
        return pd.DataFrame({"node": all_ids[has], "links": links[has], "to": all_ids[group[has]]})

    return multiply


def _met(placed: DataFrame, cosine: float, block: int) -> DataFrame:
    """(node, links, to) from every product: links are partial counts, ``to`` a node of the same group."""
    cell = F.explode(F.concat(F.array("home"), "visits"))
    met = placed.withColumn("cell", cell).withColumn("key", F.concat_ws("|", F.col("cell").cast("string"), "label"))
    sizes = saved(met.groupBy("key").agg(F.count("*").alias("all"), F.sum((F.col("home") == F.col("cell")).cast("long")).alias("own"))
                  .withColumn("parts", F.struct(F.ceil(F.col("own") / block).cast("int").alias("h"), F.ceil(F.col("all") / block).cast("int").alias("g")))
                  .filter((F.col("all") > block)).select("key", "parts", "all"), "crowded")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    met = lookup(met, "key", sizes, "parts", "all", total, ["node", "cell"])
    h, g = F.coalesce("parts.h", F.lit(1)), F.coalesce("parts.g", F.lit(1))
    every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    mine = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    guests = met.withColumns({"role": F.lit(1), "gb": mine(g)}).withColumn("hb", F.explode(every(h)))
    homes = met.filter("home = cell").withColumns({"role": F.lit(0), "hb": mine(h)}).withColumn("gb", F.explode(every(g)))
    columns = ["cell", "label", "hb", "gb", "role", "node", "n", "home", "visits", "vec"]
    dealt = homes.select(*columns).union(guests.select(*columns))
    return dealt.groupBy("cell", "label", "hb", "gb").applyInPandas(_products(cosine), "node long, links long, to long")


def groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
           cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    vec = F.col(vec_col).cast("array<double>")
    fit = (F.col(label_col).isNotNull() & (F.size(vec) > 0)
           & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0))
    label = F.concat_ws("|", F.size("vec").cast("string"), F.col("label").cast("string"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(fit, vec).alias("vec"))
    rows = rows.withColumn("label", F.when(F.col("vec").isNotNull(), label))
    key = F.concat_ws("|", F.xxhash64("label", "vec").cast("string"), F.xxhash64(F.lit(SEED), "label", "vec").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("vec").isNotNull(), key))
    classes = saved(rows.filter("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("first"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    met = None
    for dims, n in [(r.dims, r.n) for r in classes.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).collect()]:
        some = classes.filter(F.size("vec") == dims).select("node", "label", "n", "vec")
        placed = saved(_placed(some, _centres(some, n), margin(cosine)), "placed")
        part = _met(placed, cosine, block)
        met = part if met is None else met.union(part)
    if met is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    met = saved(met, "met")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = saved(classes.select("node", "key", "first", "n").join(counts, "node", "left").join(roots, "node", "left")
                  .withColumn("root", F.coalesce("root", "node")), "known")
    least = saved(known.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    answer = F.struct("component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    named = saved(known.join(least, "root").select("key", answer.alias("answer"), "n"), "named")
    slim = rows.select("id", "key")
    found = lookup(slim, "key", named, "answer", "n", slim.count(), ["id"])
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("answer.component_id"))
    return found.select(F.col("id").alias(id_col), F.coalesce("answer.n_links", F.lit(0).cast("long")).alias("n_links"),
                        component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op5_spherical_cells(spark, sf_dir):
    return groups(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT DISTINCT a AS x, a AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN least ON x = vec_id
"""
