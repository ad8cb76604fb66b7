import hashlib
import math

import numpy as np
import pytest

from tabwork.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x int"


def brute(rows, k, rounds, dims, scale=256, seed=2):
    """rows: (id, vector). The contract, written with plain loops."""
    most = C.largest(dims)
    kept = []
    for i, v in rows:
        if v is None or len(v) != dims or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(min(most, max(-most, float(c) * scale))) for c in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(x) for _, x in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(middle)) for _, x in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(middle)):
            mine = [x for (_, x), t in zip(kept, to) if t[1] == j]
            if mine:
                middle[j] = [sum(col) // len(mine) for col in zip(*mine)]
    to = assign()
    whole = sum(d for d, _ in to)
    by = {j: sum(d for d, c in to if c == j) for j in range(len(middle))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    order = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    return sorted(((i, j, d, by[j], whole, sha[j]) for (i, _), (d, j) in zip(kept, to)), key=order)


def result(df):
    got = [tuple(r) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(C.op13_integer_centroids(spark, sf)) == brute(rows, 40, 5, 64)


@pytest.mark.parametrize("k,rounds", [(1, 2), (3, 0), (3, 4), (50, 3)])
def test_defined_cases(spark, k, rounds):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 3).astype("f4")]) for i in range(40)]
    rows += [(40 + i, [0.25, -0.5, 1.0]) for i in range(60)]                      # a hot vector, ties
    rows += [(3, [2.0, 2.0, 2.0]), (3, [2.0, 2.0, 2.0]), (None, [1.0, 0.0, -1.0]), (None, [-1.0, 0.0, 1.0])]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [float("nan"), 0.0, 0.0]),
             (205, [float("inf"), 0.0, 0.0]), (206, [0.0, -float("inf"), 0.0]), (207, [1.0] * 4), (208, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, "c", 1) for i, v in rows], SCHEMA).repartition(7)
    got = C.digest(C.clustered(df, "vec_id", "embedding", k=k, rounds=rounds, dims=3))
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(got) == brute(rows, k, rounds, 3)


def test_largest_components_do_not_overflow(spark):
    far = 3.0e38
    rows = [(i, [far] * 64) for i in range(3)] + [(i, [-far] * 64) for i in range(3, 6)]
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], SCHEMA)
    found = C.clustered(df, "vec_id", "embedding", k=1, rounds=0)
    assert 64 * (2 * C.largest(64)) ** 2 <= C.LONG < 64 * (2 * C.largest(64) + 2) ** 2
    assert sum(found.inertias) == 3 * 64 * (2 * C.largest(64)) ** 2 > C.LONG
    assert {r.inertia for r in C.digest(found).collect()} == {C.LONG}


def test_empty(spark):
    got = C.digest(C.clustered(spark.createDataFrame([], SCHEMA), "vec_id", "embedding"))
    assert got.collect() == [] and dict(got.dtypes)["inertia"] == "bigint" and dict(got.dtypes)["cluster"] == "int"


def test_plan_is_jvm_only(spark, sf):
    numbers = C.whole_numbers(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    start = C.first_centroids(numbers, 5)
    plan = numbers.select(C.nearest(start)["cluster"].alias("cluster"), "x").groupBy("cluster").agg({"cluster": "count"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
