import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tabwork.operators.train import boards as B


def brute(x, label, noise=-1):
    """(inner, outer, silhouette) of every row with a cluster, from all pairs."""
    x = np.array(x, float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    clusters = sorted({c for c in label if c is not None and c != noise})
    out = {}
    for i, c in enumerate(label):
        if c not in clusters:
            continue
        own = [j for j, o in enumerate(label) if o == c and j != i]
        inner = d[i, own].mean() if own else None
        outer = min((d[i, [j for j, o in enumerate(label) if o == e]].mean() for e in clusters if e != c), default=None)
        if outer is None:
            s = None
        elif not own or max(inner, outer) == 0:
            s = 0.0
        else:
            s = (outer - inner) / max(inner, outer)
        out[i] = (inner, outer, s)
    return out


def made(seed=0, n=90):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(n // 3, 3)) * 0.3 + c for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1))])
    return x.tolist() + [[0.0, 0.0, 0.0]] * 4


def test_silhouettes_of_several_labellings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "HELD", 150)  # sums are handed on many times
    x = made()
    one = [i // 30 for i in range(90)] + [0, 0, 7, None]            # a cluster of one row, a row without
    two = [i % 4 - 1 for i in range(94)]                            # -1 is noise
    single = [3] * 94
    rows = [(i, v, a, b, c) for i, (v, a, b, c) in enumerate(zip(x, one, two, single, strict=True))]
    odd = [(900, None, 0, 0, 3), (901, [None, 1.0, 2.0], 0, 0, 3)]
    frame = spark.createDataFrame(rows + odd, "id long, x array<double>, one int, two int, single int").repartition(5)
    got = {}
    for r in B.silhouettes(frame, "id", "x", ["one", "two", "single"]).collect():
        got.setdefault(r.labelling, {})[r.id] = (r.inner, r.outer, r.silhouette)
    for name, label in (("one", one), ("two", two), ("single", single)):
        want = brute(x, label)
        assert got[name].keys() == want.keys()
        for i in want:
            assert got[name][i] == pytest.approx(want[i], abs=1e-9) if None not in want[i] else got[name][i][2] == want[i][2]


def test_asked_rows_are_compared_with_all(spark):
    x = made(1)
    label = [i // 30 for i in range(90)] + [0] * 4
    frame = spark.createDataFrame(list(zip(range(94), x, label, strict=True)), "id long, x array<double>, c int").repartition(3)
    want, got = brute(x, label), B.silhouettes(frame, "id", "x", ["c"], sample=10).collect()
    assert len(got) == 10 and all(r.silhouette == pytest.approx(want[r.id][2], abs=1e-9) for r in got)
    assert B.silhouettes(frame.where("id < 0"), "id", "x", ["c"]).collect() == []


def test_cluster_board_ranks_both_models_by_their_own_silhouette(spark):
    x = made(2)
    frame = spark.createDataFrame(list(enumerate(x)), "vec long, x array<double>").select("vec", array_to_vector("x").alias("features"))
    board, assigned = B.cluster_board(frame, "vec")
    board, rows = board.collect(), {r.vec: r for r in assigned.collect()}
    assert len(rows) == 94 and [r.score for r in board] == sorted((r.score for r in board), reverse=True)
    by = {r.model: r for r in board}
    assert by["KMeans"].n_clusters == 3 and by["KMeans"].n_noise == 0
    for model, column in (("KMeans", "kmeans"), ("DBSCAN", "dbscan")):
        label = [rows[i][column] for i in range(94)]
        found = [s for _, _, s in brute(x, label).values() if s is not None]
        assert by[model].silhouette == pytest.approx(np.mean(found) if found else 0.0, abs=1e-9)
        assert by[model].n_clusters == len(set(label) - {-1}) and by[model].n_noise == label.count(-1)
    centre = {c: np.mean([x[i] for i in rows if rows[i].kmeans == c], axis=0) for c in range(3)}
    assert by["KMeans"].inertia == pytest.approx(sum(((np.array(x[i]) - centre[rows[i].kmeans]) ** 2).sum() for i in rows))
    assert B.cluster_board(frame.where("vec < 0"), "vec")[0].collect() == []


def test_anomaly_board_finds_the_planted_rows_with_both_detectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(190, 3)).tolist() + [(8 * v / np.linalg.norm(v) + r.normal(size=3)).tolist() for v in r.normal(size=(10, 3))]
    rows = [(5 if i < 2 else i, v, int(i >= 190) if i else None) for i, v in enumerate(x)]  # two rows share an id
    frame = spark.createDataFrame(rows, "id long, x array<double>, bad int").select("id", array_to_vector("x").alias("features"), "bad")
    board, labelled = B.anomaly_board(frame, "id", contamination=0.05, truth="bad")
    board, labelled = board.collect(), labelled.collect()
    assert {b.model for b in board} == {"Isolation Forest", "Local Outlier Factor"} and len(labelled) == 400
    assert [b.gap for b in board] == sorted(b.gap for b in board)
    for b in board:
        mine = [x for x in labelled if x.model == b.model]
        cut = np.quantile([x.score for x in mine], 0.95)
        flagged = [x for x in mine if x.score >= cut - 1e-12]
        assert b.n == 200 and b.n_anomalies == len(flagged) == sum(x.is_anomaly for x in mine)
        hits = sum(x.truth == 1 for x in flagged)
        assert b.precision == pytest.approx(hits / len(flagged)) and b.recall == pytest.approx(hits / 10) and b.f1 >= 0.7
