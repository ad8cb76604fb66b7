import datetime

import numpy as np
import pandas as pd

from tabwork.operators.train import forecast as FC


def loop_holt(y, h):
    best = None
    for a in FC.HOLT_GRID:
        for b in FC.HOLT_GRID:
            level, trend, sse = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                f = level + trend
                sse += (v - f) ** 2
                new = a * v + (1 - a) * f
                trend = b * (new - level) + (1 - b) * trend
                level = new
            if best is None or sse < best[0]:
                best = (sse, level + trend * np.arange(1, h + 1))
    return best[1]


def test_holt_over_the_whole_grid_at_once():
    r = np.random.default_rng(0)
    for n in (3, 10, 60):
        y = np.cumsum(r.normal(1, 2, n))
        assert np.allclose(FC._holt(y, 4)[0], loop_holt(y, 4))
    assert np.allclose(FC._holt(np.array([5.0]), 2)[0], [5, 5])


def test_holt_chunks_equal_the_plain_loop(spark):
    r = np.random.default_rng(4)
    day = datetime.date(1990, 1, 1)
    whole = {"a": 1e6 + np.cumsum(r.normal(1, 2, 700)), "b": r.normal(0, 1, 65), "c": np.full(40, 7.0), "d": np.array([1.0, 4.0, 2.0, 9.0])}
    rows = [(s, f, i + 1, "train" if i < n - 5 - 3 * f else "test", day + datetime.timedelta(days=i), float(v))
            for s, y in whole.items() for n in [len(y)] for f in (0, 1) for i, v in enumerate(y) if i < n - 3 * f or n < 9]
    rows += [("e", 0, i + 1, "test", day, 3.0) for i in range(2)]  # nothing to learn from
    folds = spark.createDataFrame(rows, "series string, fold long, pos long, role string, ts date, y double").repartition(5)
    got = FC.forecast_holt(folds, chunk=16).toPandas()
    assert len(got) == sum(x[3] == "test" for x in rows)
    for (s, f), part in got.groupby(["series", "fold"]):
        part = part.sort_values("pos")
        y = np.array([x[5] for x in sorted(rows, key=lambda x: x[2]) if x[:2] == (s, f) and x[3] == "train"])
        want = loop_holt(y, len(part)) if len(y) >= 3 else np.repeat(y[-1] if len(y) else 0.0, len(part))
        assert np.allclose(part.predicted, want, rtol=1e-9, atol=1e-6)


def made(spark, n=90):
    day = datetime.date(2024, 1, 1)
    rows = [(s, day + datetime.timedelta(days=i), float((i % 7) * k + 3 * k)) for s, k in (("a", 1), ("b", 4)) for i in range(n)]
    return spark.createDataFrame(rows, "series string, ts date, y double")


def test_lag_models_are_back_tested_on_unseen_rows(spark):
    series = made(spark)
    got = FC.backtest_lag_models(series, lags=7, max_iter=20).toPandas()
    assert set(got.model) == {"lag_ridge", "lag_gbm"} and set(got.fold) == set(range(5))
    naive = FC.forecast_naive(FC.backtest_frame(series)).toPandas()
    rmse = lambda p: float(np.sqrt(((p.actual - p.predicted) ** 2).mean()))
    assert rmse(got[got.model == "lag_ridge"]) < 0.2 * rmse(naive) and rmse(got[got.model == "lag_gbm"]) < 0.5 * rmse(naive)
    for _, part in got.groupby(["series", "fold", "model"]):  # test windows follow the training rows
        assert part.pos.is_unique and part.pos.min() > 7
    both = pd.concat([got, naive.assign(model="naive")])[["series", "fold", "pos", "ts", "actual", "predicted", "model"]]
    board = FC.forecast_board(spark.createDataFrame(both)).toPandas().sort_values("rank")
    assert list(board["rank"]) == [1, 2, 3] and board.model.iloc[-1] == "naive" and board.rmse.is_monotonic_increasing
    ahead = pd.concat([got, naive.assign(model="naive", horizon=None)])[["series", "fold", "pos", "ts", "actual", "predicted", "model", "horizon"]]
    ahead = ahead.assign(horizon=ahead.horizon.map(lambda h: None if pd.isna(h) else int(h)).astype(object))
    frame = spark.createDataFrame(ahead.astype({"pos": int}).where(ahead.notna(), None), "series string, fold int, pos long, ts date, actual double, "
                                  "predicted double, model string, horizon long")
    horizon = {r.model: r.horizon for r in FC.forecast_board(frame).collect()}
    assert horizon == {"lag_ridge": 1, "lag_gbm": 1, "naive": naive.groupby(["series", "fold"]).size().max()}
