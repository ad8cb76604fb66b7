"""Centroid clustering in integers: Lloyd rounds as JVM expressions.

Vectors become arrays of whole numbers, floor(SCALE * x).  In each round zip_with and aggregate give a
vector's squared distance to every centroid, |x|^2 - 2 x.c + |c|^2, the centroids standing in the plan as
literal arrays; array_min over structs (distance, number) chooses the nearest, ties the smaller number.  Then one
aggregation sums each component by cluster, inside generated code, and the driver divides: it sees
k rows of sums per salt and nothing else.  All arithmetic is exact, so the result does not depend on
partitions or on the order of rows.

A cluster may hold most of the vectors: sums are combined in each task before the shuffle and dealt over
SALTS parts of a cluster after it.  The whole numbers are written to the shared folder once, and
each round is one scan of that table; a lost executor repeats tasks of one round.

Defined cases: vectors that are null, of another length than ``dims``, or hold a null or non-finite
component are left out; rows of equal id are separate vectors, and a null id counts as the empty text in
the choice of the first centroids; equal hashes there are ordered by the vectors; with fewer vectors
than k there are fewer centroids; a centroid without vectors stays as it is; a component beyond LARGEST
counts as LARGEST (about 741,000 before scaling), since a squared distance must fit a long, and an
inertia beyond a long is given as the largest long; an empty table gives an empty result; other
columns are ignored.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2          # written before the id in the hash that chooses the first centroids
SALTS = 8         # parts a cluster's sums are dealt over
LONG = (1 << 63) - 1


def largest(dims: int) -> int:
    """The largest component whose squared distances over ``dims`` components fit a long."""
    reach = int((LONG // dims) ** 0.5) // 2
    while dims * (2 * reach) ** 2 > LONG:
        reach -= 1
    return reach


@dataclass
class Clustering:
    rows: DataFrame              # id, cluster, distance
    centroids: list[list[int]]
    inertias: list[int]          # exact, by cluster


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, x, own) of the vectors with exactly ``dims`` finite components, as arrays of whole numbers; own = |x|^2."""
    raw = F.col(vec_col).cast("array<double>")
    infinite = F.lit(float("inf"))
    whole = raw.isNotNull() & (F.size(raw) == dims) & F.forall(
        raw, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < infinite), F.lit(False)))
    most = largest(dims)
    number = F.transform(raw, lambda v: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), v * scale))))
    return df.filter(whole).select(F.col(id_col).alias("id"), number.alias("x")).withColumn("own", _product(F.col("x"), F.col("x")))


def _product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)


def first_centroids(numbers: DataFrame, k: int, seed: int = SEED) -> list[list[int]]:
    """The k vectors of smallest SHA-256 of ``seed:id``: a top-k, k rows in the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    best = numbers.select(F.sha2(name.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k)
    return [list(r.x) for r in best.collect()]


def nearest(centroids: list[list[int]], x: str = "x", own: str = "own") -> Column:
    """struct(distance, cluster) of the nearest centroid."""
    # one literal for all centroids: as SQL text it is parsed at once, as columns it is thousands of calls to the JVM
    named = [f"named_struct('x',array({','.join(f'{v}L' for v in c)}),'own',{sum(v * v for v in c)}L)" for c in centroids]
    every = F.expr(f"array({','.join(named)})")

    def distance(c: Column) -> Column:
        return F.col(own) - F.lit(2).cast("long") * _product(F.col(x), c["x"]) + c["own"]

    return F.array_min(F.transform(every, lambda c, i: F.struct(distance(c).alias("distance"), i.alias("cluster"))))


def _moved(numbers: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: componentwise floor(sum / count) of the vectors nearest to each."""
    dims = len(centroids[0])
    placed = numbers.select("x", nearest(centroids)["cluster"].alias("cluster"),
                            F.pmod(F.xxhash64("id", "x"), F.lit(SALTS)).alias("salt"))
    sums = placed.groupBy("cluster", "salt").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)])
    total: dict[int, list[int]] = {}
    for row in sums.collect():  # at most k * SALTS rows
        held = total.setdefault(row.cluster, [0] * (dims + 1))
        for i, v in enumerate(row[2:]):
            held[i] += v
    return [[s // total[c][0] for s in total[c][1:]] if c in total else old for c, old in enumerate(centroids)]


def clustered(df: DataFrame, id_col: str, vec_col: str, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
              scale: int = SCALE, seed: int = SEED) -> Clustering:
    """``rounds`` rounds of assignment and update, and a last assignment."""
    numbers = saved(whole_numbers(df, id_col, vec_col, dims, scale), "whole-numbers")
    centroids = first_centroids(numbers, k, seed)
    if not centroids:
        none = numbers.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return Clustering(none, [], [])
    for _ in range(rounds):
        centroids = _moved(numbers, centroids)
    best = numbers.select("id", nearest(centroids).alias("best"))
    rows = saved(best.select("id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance")), "clusters")
    inertias = [0] * len(centroids)
    # a sum of longs in decimals cannot overflow
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s"))
    for row in sums.collect():  # at most k rows
        inertias[row.cluster] = int(row.s)
    return Clustering(rows, centroids, inertias)


def digest(found: Clustering) -> DataFrame:
    """The rows with their cluster's and the whole inertia and the SHA-256 of their centroid."""
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    inertias = [min(v, LONG) for v in found.inertias]
    return found.rows.select(
        "id", "cluster", "distance", of(inertias or [0]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(found.inertias), LONG)).cast("long").alias("inertia"), of(named or [""]).alias("centroid_sha256"))


def op13_integer_centroids(spark, sf_dir):
    found = clustered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return digest(found).withColumnRenamed("id", "vec_id")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in DuckDB: one pair of expressions per round."""
    def assigned(step: int) -> str:
        gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        return (f"a{step} AS MATERIALIZED (SELECT rid, id, x, best[2]::INTEGER AS cluster, best[1] AS distance FROM ("
                f"SELECT v.rid, any_value(v.id) AS id, any_value(v.x) AS x, min([{gap}, c.cluster]) AS best "
                f"FROM kept v, c{step} c GROUP BY v.rid))")

    def moved(step: int) -> str:
        floors = "(s - ((s % n) + n) % n) // n"
        return (f"m{step} AS (SELECT cluster, list(({floors})::BIGINT ORDER BY i) AS x FROM (SELECT cluster, i, sum(x[i]) AS s, "
                f"count(*)::HUGEINT AS n FROM a{step}, range(1, {dims + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster), "
                f"c{step + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{step} c LEFT JOIN m{step} m USING (cluster))")

    steps = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(rounds))
    last = rounds
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id AS id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS cluster, x
  FROM (SELECT sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h, x FROM kept) ORDER BY h, x LIMIT {k}),
{steps}, {assigned(last)}
SELECT a.id AS vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c USING (cluster)"""


OP13_SQL = _sql()
