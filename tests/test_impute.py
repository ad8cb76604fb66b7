import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwork.operators import clean, impute


def brute(rows, k):
    """rows: lists of floats or None; the definition with plain loops."""
    n = len(rows[0])
    held = [[r[j] for r in rows if r[j] is not None] for j in range(n)]
    span = [(max(h) - min(h)) or 1.0 if h else 1.0 for h in held]
    out = []
    for a in rows:
        new = list(a)
        for c in range(n):
            if a[c] is not None:
                continue
            found = []
            for b in rows:
                both = [j for j in range(n) if a[j] is not None and b[j] is not None]
                if b[c] is None or not both:
                    continue
                d2 = sum((a[j] / span[j] - b[j] / span[j]) ** 2 for j in both) * n / len(both)
                found.append((round(d2, 9), b[c]))
            found.sort()
            near = [v for d, v in found if d <= found[min(k, len(found)) - 1][0]]
            new[c] = float(np.mean(near)) if near else (float(np.median(held[c])) if held[c] else None)
        out.append(new)
    return out


def gappy(n, d, share, seed, grid=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * 10 ** np.arange(d)
    if grid:
        x = np.round(r.normal(size=(n, d)) * grid)
    x[: n // 3] = x[0]  # a third of all rows are copies
    gone = r.random((n, d)) < share
    gone[n // 2:, 1:] = False
    return [[None if g else float(v) for v, g in zip(row, mask)] for row, mask in zip(x.tolist(), gone)]


def frame(spark, rows):
    names = [f"m.{j}" for j in range(len(rows[0]))]
    return spark.createDataFrame([(i, *r, "z") for i, r in enumerate(rows)],
                                 "id long, " + ", ".join(f"`{c}` double" for c in names) + ", _row string"), names


def filled(df, names):
    return [[r[c] for c in names] for r in sorted(df.collect(), key=lambda r: r.id)]


@pytest.mark.parametrize("patterns", [64, 0])
@pytest.mark.parametrize("grid", [None, 3])
def test_equals_brute_force(spark, patterns, grid):
    rows = gappy(150, 3, 0.25, 1, grid) + [[None, None, None], [0.5, None, None]]
    df, names = frame(spark, rows)
    got = impute.knn_impute(df.repartition(5), names, k=4, leaf=12, block=16, patterns=patterns)
    assert got.columns == df.columns
    np.testing.assert_allclose(np.array(filled(got, names)), np.array(brute(rows, 4)), rtol=1e-9)


def test_defined_cases(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1, nan, None, "a"), (2, None, 4.0, None, "a"), (3, 5, 6.0, None, "b"), (4, None, None, None, "b"), (4, None, None, None, "b")],
                               "id long, whole int, x double, none double, g string")
    got = {r.id: r for r in impute.knn_impute(df, ["whole", "x", "none"], k=1, group_by=["g"]).collect()}
    assert got[1].x == 6.0                      # its only donor that shares a column
    assert got[2].whole == 5 and got[4].whole == 5 and got[4].x == 6.0  # rows without values: the median of their group
    assert got[1].none is None and got[1].whole == 1
    every = impute.knn_impute(df, ["whole", "x"], k=9)
    assert every.count() == 5 and every.where("x is null or whole is null").count() == 0
    assert impute.knn_impute(df.where("id > 9"), ["whole", "x"]).collect() == []
    assert impute.knn_impute(df.select("id", "g"), []).count() == 5
    only = impute.knn_impute(df, ["whole", "x"], wanted=["x"], k=1)
    assert only.where("whole is null").count() == 3 and only.where("x is null").count() == 0


def test_cleaning_strategy(spark):
    rows = [[float(i % 7), float(i % 7) * 2 if i % 5 else None] for i in range(60)]
    df, names = frame(spark, rows)
    got = clean.clean_apply(df.drop("id"), [{"column": names[1], "strategy": "knn_impute"}])
    assert got.where(F.abs(F.col("`m.1`") - 2 * F.col("`m.0`")) > 1e-9).count() == 0 and got.count() == 60
    assert not math.isnan(got.agg(F.sum("`m.1`")).first()[0])


def test_donors_are_not_copied_for_every_way_to_miss_columns(spark, monkeypatch):
    from tabwork.operators import cells
    met, seen = cells.met, []

    def counted(points, guests, *rest):
        seen.append((points.count(), guests.count()))
        return met(points, guests, *rest)

    monkeypatch.setattr(cells, "met", counted)
    r = np.random.default_rng(5)
    rows = [[float(v) for v in x] for x in r.uniform(size=(600, 4))]
    for i, row in enumerate(rows[:60]):
        row[i % 4] = None
        if i % 3 == 0:
            row[(i + 1) % 4] = None
    df, names = frame(spark, rows)
    got = impute.knn_impute(df, names, k=5, block=50, leaf=10)
    np.testing.assert_allclose(np.array(filled(got, names)), np.array(brute(rows, 5)), rtol=1e-9)
    asked = sum(v is None for row in rows for v in row)
    assert [p for p, _ in seen] == [600, 600]          # every different row once
    assert seen[0][1] == asked and seen[1][1] < 20 * asked  # and not every cell of theirs is asked
