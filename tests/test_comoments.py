import numpy as np
import pytest

from tabwork.operators import comoments as C
from tabwork.operators import eda


def frame(spark, x, parts=5):
    names = [f"v.{j}" for j in range(x.shape[1])]
    rows = [[None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(parts), names


def gappy(n, d, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 1)) + r.normal(size=(n, d)) * np.arange(1, d + 1)
    x[:, 0] += 1e9          # a large mean against the spread
    x[:, 1] = 0.1           # constant
    x[r.random((n, d)) < 0.2] = np.nan
    x[:, 2] = np.nan        # empty
    x[: n - 1, 3] = np.nan  # one value
    return x


@pytest.mark.parametrize("width,pairs,cells", [(512, 10, 1 << 21), (3, 2, 60)])
def test_equals_plain_pairs(spark, monkeypatch, width, pairs, cells):
    monkeypatch.setattr(C, "WIDTH", width)
    monkeypatch.setattr(C, "PAIRS", pairs)
    monkeypatch.setattr(C, "CELLS", cells)
    x = gappy(400, 8)
    df, names = frame(spark, x)
    got = {(r.a, r.b): r for r in C.comoments(df, names).collect()}
    assert set(got) == {(i, j) for i in range(8) for j in range(i, 8)}
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        assert r.n == both.sum()
        if len(a):
            da, db = a - a.mean(), b - b.mean()
            np.testing.assert_allclose([r.ma, r.mb], [a.mean(), b.mean()], rtol=1e-12)
            np.testing.assert_allclose([r.aa, r.bb, r.ab], [da @ da, db @ db, da @ db], rtol=1e-6, atol=1e-6)
        assert (1 not in (i, j)) or r.ab == 0  # exactly


def test_matrix(spark):
    x = gappy(300, 6, 3)
    df, names = frame(spark, x)
    got = {(r.col_a, r.col_b): r.r for r in eda.eda_correlation_matrix(df).collect()}
    assert len(got) == 36
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            dead = both.sum() < 2 or np.ptp(x[both, i]) == 0 or np.ptp(x[both, j]) == 0
            want = 0.0 if dead else 1.0 if i == j else np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert abs(got[names[i], names[j]] - want) < 1e-6
    empty = eda.eda_correlation_matrix(df.limit(0)).collect()
    assert len(empty) == 36 and {r.r for r in empty} == {0.0}
    odd = spark.createDataFrame([(1.0, float("inf")), (2.0, 1.0), (3.0, 2.0)], "a double, b double")
    assert {(r.col_a, r.col_b): r.r for r in eda.eda_correlation_matrix(odd).collect()}["a", "b"] == 0.0


def test_cells_of_mutual_information_are_pre_aggregated(spark):
    df = spark.range(5000).selectExpr("cast(id % 7 as double) as a", "cast(id as double) as b", "cast(id % 3 as string) as y").repartition(4)
    plan = eda._bin_plan(df, ["a", "b"], 10, 20, None)
    cells = df.select("a", "b", "y").mapInArrow(eda._cells(["a", "b"], plan, None), "feature string, x double, y string, n long")
    rows = cells.collect()
    assert len(rows) <= 4 * (7 * 3 + 10 * 3) and sum(r.n for r in rows) == 10_000
    mi = {r.feature: r.mi for r in eda.mutual_information(df, ["a", "b"], "y").collect()}
    assert mi["a"] < 0.01 and mi["b"] < 0.01
