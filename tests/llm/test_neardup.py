import numpy as np

from tabwork.llm import neardup


def brute(rows, cosine=0.93):
    ok = []
    for _, v, label in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, float) if good else None)
    n, links, up = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(n):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i in range(n):
        ids = [x for x in least[find(i)] if x is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], links[i], c, c == rows[i][0]))
    return sorted(out, key=str)


def near(r, v, cosine):
    w = r.normal(size=len(v))
    w -= v * (w @ v) / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def made(n, dims, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    rows = [(i, base[i].tolist(), int(i % 3)) for i in range(n)]
    for k, c in enumerate([0.9299, 0.9301, 0.95, 0.99, 1.0]):
        rows += [(10_000 + 1000 * k + i, (near(r, base[i], c) * (1 + i)).tolist(), int(i % 3)) for i in range(0, n, 4)]
    dense = [(50_000 + i, near(r, base[0], 0.985).tolist(), 0) for i in range(80)]
    same = [(60_000 + i, base[1].tolist(), 1) for i in range(50)]
    odd = [(70_000, None, 1), (70_001, [], 1), (70_002, [0.0] * dims, 1), (70_003, [float("nan")] * dims, 1),
           (70_004, [None] + [1.0] * (dims - 1), 1), (70_005, base[0].tolist(), None), (70_006, [float("inf")] * dims, 0),
           (None, base[2].tolist(), 2), (5, base[7].tolist(), 1), (70_007, base[0].tolist()[:-1], 0)]
    return rows + dense + same + odd


def run(spark, rows, **options):
    frame = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<double>, label int, kept int")
    return sorted((tuple(x) for x in neardup.groups(frame.repartition(5), **options).collect()), key=str)


def test_brute_force_in_one_cell(spark):
    rows = made(120, 8)
    assert run(spark, rows) == brute(rows)


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PER_CELL", 25)
    rows = made(200, 8, seed=1)
    assert run(spark, rows, block=16) == brute(rows)


def test_recall_in_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PER_CELL", 20)
    r = np.random.default_rng(5)
    base = r.normal(size=(400, 64))
    rows = [(i, base[i].tolist(), 0) for i in range(400)]
    rows += [(1000 + i, near(r, base[i % 400], 0.931).tolist(), 0) for i in range(800)]
    want = {x[0]: x[1] for x in brute(rows)}
    got = {x[0]: x[1] for x in run(spark, rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_no_link_is_lost_among_vectors_of_low_rank(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PER_CELL", 20)
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 3)) @ np.linalg.qr(r.normal(size=(64, 3)))[0].T  # differences along three directions
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 3)]) == [(1, 0, 1, True)]
