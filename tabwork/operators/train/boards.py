"""Candidate boards of unlabelled tables (survey §2.10): clusterings by silhouette, detectors by found share."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import neighbours as NB
from ..metric_tree import kept, squared
from . import unsupervised as U

SILHOUETTE_SAMPLE = 5_000   # fixed value: rows whose silhouette is taken, each against all rows
HELD = 1 << 22              # sums a task holds before it hands them on
NOISE = -1


def silhouettes(rows: DataFrame, id_col: str, vec_col: str, labellings: list[str], sample: int = SILHOUETTE_SAMPLE,
                noise: int | None = NOISE) -> DataFrame:
    """(labelling, id, cluster, inner, outer, silhouette) with Euclidean distances, for several labellings in one pass.

    ``sample`` rows, chosen by a hash of the id, are asked; each is compared with every row, so a table of at
    most ``sample`` rows has its whole silhouette and a larger one an unbiased mean.  ``inner`` is the mean
    distance to the other rows of the row's cluster, ``outer`` the least mean distance to another cluster.
    The row of a one-row cluster has silhouette 0; a labelling with one cluster has none.  Rows with a null label or the
    label ``noise`` belong to no cluster of that labelling; rows with an incomplete vector to none at all.
    Several rows may share an id.
    """
    points = NB.complete(rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"),
                                     *[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(labellings)]), "x")
    points = kept(points.withColumn("row", F.monotonically_increasing_id()))
    marks = [f"c{i}" for i in range(len(labellings))]
    asked = kept(points.orderBy(F.xxhash64("id", F.lit(U.SEED)), "row").limit(sample))
    held = asked.select("row", "x", *marks).toPandas()  # at most ``sample`` rows
    spark, schema = rows.sparkSession, "part int, row long, cluster long, own boolean, total double, n long"
    ask = np.array(held.x.tolist(), float).reshape(len(held), -1) if len(held) else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast((ask, held.row.to_numpy(np.int64),
                                         [held[c].to_numpy(float, na_value=np.nan) for c in marks]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, names, theirs = sent.value
        totals: dict[tuple[int, int], list] = {}

        def handed():
            for (part, cluster), (total, n) in totals.items():
                mine = theirs[part] == cluster
                there = ~np.isnan(theirs[part]) & (theirs[part] != noise)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "part": np.int32(part), "row": names[there], "cluster": np.int64(cluster), "own": mine[there],
                    "total": total[there], "n": np.int64(n)}), preserve_index=False)
            totals.clear()

        for batch in batches:
            if not batch.num_rows or not len(ask):
                continue
            x = np.array(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            for start in range(0, len(x), 512):
                apart = np.sqrt(squared(ask, x[start:start + 512]))
                for part in range(len(theirs)):
                    label = batch.column(1 + part).slice(start, 512).to_numpy(zero_copy_only=False).astype(float)
                    label[label == noise] = np.nan
                    for cluster in np.unique(label[~np.isnan(label)]).astype(int).tolist():
                        mine = label == cluster
                        held_sum = totals.setdefault((part, cluster), [np.zeros(len(ask)), 0])
                        held_sum[0] += apart[:, mine].sum(axis=1)
                        held_sum[1] += int(mine.sum())
                if len(totals) * len(ask) > HELD:
                    yield from handed()
        yield from handed()

    found = points.select("x", *marks).mapInArrow(sums, schema)
    each = found.groupBy("part", "row", "cluster", "own").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own, n = F.col("own"), F.col("n")
    per_row = each.groupBy("part", "row").agg(
        F.max(F.when(own, F.col("cluster"))).alias("cluster"), F.max(F.when(own, n)).alias("size"),
        F.max(F.when(own & (n > 1), F.col("total") / (n - 1))).alias("inner"),
        F.min(F.when(~own, F.col("total") / n)).alias("outer"))
    most = F.greatest("inner", "outer")
    value = (F.when(F.col("outer").isNull(), None).when((F.col("size") == 1) | (most == 0), 0.0)
             .otherwise((F.col("outer") - F.col("inner")) / most))
    names = F.array(*[F.lit(c) for c in labellings])
    return per_row.join(asked.select("row", "id"), "row").select(
        names[F.col("part")].alias("labelling"), F.col("id").alias(id_col), "cluster", "inner", "outer", value.alias("silhouette"))


def cluster_board(vectors: DataFrame, id_col: str, n_clusters: int = 8, max_k: int = 15, min_samples: int = 5,
                  sample: int = SILHOUETTE_SAMPLE) -> tuple[DataFrame, DataFrame]:
    """k-means with the best k and DBSCAN by automatic eps, ranked by Euclidean silhouette; and each row's clusters.

    The board holds (model, n_clusters, n_noise, silhouette, inertia, eps, score): score is the silhouette, 0 where
    it is negative or there are not two clusters.  DBSCAN's silhouette leaves noise out, its clusters are numbered by
    their smallest row.  All k are judged in one pass over the distances.
    """
    spark = vectors.sparkSession
    rows = kept(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), "features",
                               vector_to_array("features").alias("x")))
    n = rows.count()
    schema = "model string, n_clusters long, n_noise long, silhouette double, inertia double, eps double, score double"
    if n < 2:
        return spark.createDataFrame([], schema), rows.select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("kmeans"),
                                                              F.lit(None).cast("long").alias("dbscan"))
    ks = list(range(2, max(2, min(n_clusters, int(math.sqrt(n)), max_k)) + 1))
    placed, cost = rows, {}
    for k in ks:
        model = KMeans(k=k, seed=U.SEED, featuresCol="features", predictionCol=f"k{k}").fit(rows)
        cost[k] = float(model.summary.trainingCost)
        placed = model.transform(placed)
    points, _ = NB.distinct_points(rows, "row", "x")
    eps = NB.dbscan_eps(points, rank=min_samples - 1)
    dense = NB.cluster_dbscan(rows, "row", "x", eps=eps, min_samples=min_samples).withColumnRenamed("cluster", "dbscan")
    placed = kept(placed.drop("features").join(dense, "row", "left"))
    labellings = [*[f"k{k}" for k in ks], "dbscan"]
    means = {r.labelling: r.s for r in silhouettes(placed, "row", "x", labellings, sample).groupBy("labelling").agg(
        F.avg("silhouette").alias("s")).where("s is not null").collect()}
    best = min(ks, key=lambda k: (-means.get(f"k{k}", -math.inf), k))
    shape = placed.agg(F.countDistinct(F.when(F.col("dbscan") != NOISE, F.col("dbscan"))).alias("clusters"),
                       F.sum((F.col("dbscan") == NOISE).cast("long")).alias("noise"),
                       F.countDistinct(f"k{best}").alias("k")).first()
    km, db = means.get(f"k{best}"), means.get("dbscan", 0.0)
    board = [("KMeans", shape.k, 0, km, cost[best], None, max(km or 0.0, 0.0)),
             ("DBSCAN", shape.clusters, shape.noise, db, None, float(eps), max(db, 0.0))]
    board.sort(key=lambda r: (-r[-1], r[0] != "KMeans"))
    assigned = placed.select(F.col("id").alias(id_col), F.col(f"k{best}").cast("long").alias("kmeans"), "dbscan")
    return spark.createDataFrame(board, schema), assigned


def anomaly_board(vectors: DataFrame, id_col: str, contamination: float = 0.05, truth: str | None = None,
                  neighbours: int = 20) -> tuple[DataFrame, DataFrame]:
    """Isolation forest beside the local outlier factor: (board, labelled rows).

    Both label the rows at or above their own (1 - contamination) quantile; the board holds each one's found share, score
    percentiles and, with ``truth`` (non-zero marks an anomaly), precision, recall and F1, ranked by the
    distance between found and asked share.  Labelled rows are (row, id, model, score, is_anomaly, truth and percentiles).
    """
    extra = [F.col(truth).cast("double").alias("truth")] if truth else []
    rows = kept(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias(id_col), "features", *extra))
    lof = NB.local_outlier_factor(rows.withColumn("x", vector_to_array("features")), "row", "x", k=neighbours)
    scores = {"Isolation Forest": U.isolation_forest(rows, "row"), "Local Outlier Factor": lof}
    labelled = None
    for model, score in scores.items():
        part = U.anomaly_threshold(kept(score), contamination).withColumn("model", F.lit(model))
        labelled = part if labelled is None else labelled.unionByName(part)
    labelled = kept(rows.drop("features").join(labelled, "row"))
    board = U.anomaly_summary(labelled, ["model"])
    if truth:
        board = board.join(U.anomaly_supervised_metrics(labelled, "truth", ["model"]), "model")
    return U.anomaly_rank(board, min(max(contamination, 0.01), 0.49)), labelled
