"""Forecasting (survey §2.10) over many series at once.

Input is long ``(series, ts, y)``.  Backtests use expanding-window folds per
series (``sampling.folds_time_series``).  Naive forecasts and metrics are
DataFrame aggregates; Holt smoothing runs over chunks of a series (``applyInPandas``),
whose affine maps compose, so one long series is many tasks; lag models are one global Spark
ML model over all series' lag rows.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..features import fe_lags
from ..sampling import folds_time_series
from .cv import ROWS_A_TASK, concurrently, kept

HOLT_GRID = [round(x, 2) for x in np.arange(0.1, 1.0, 0.1)]
HOLT_CHUNK = 4096  # observations that one task smooths at a time


def backtest_frame(series: DataFrame, n_splits: int = 5) -> DataFrame:
    return folds_time_series(series, "series", "ts", n_splits)


def forecast_naive(folds: DataFrame) -> DataFrame:
    """Last training value of each (series, fold) repeated over its test rows."""
    last = (folds.where(F.col("role") == "train").groupBy("series", "fold")
            .agg(F.max_by("y", "pos").alias("predicted")))
    test = folds.where(F.col("role") == "test").select("series", "fold", "pos", "ts", F.col("y").alias("actual"))
    return test.join(last, ["series", "fold"]).withColumn("model", F.lit("naive"))


def forecast_backtest(preds: DataFrame, by: list[str] = ("model", "fold")) -> DataFrame:
    """RMSE, MAE, MAPE (non-zero actuals), sMAPE per group, plus rank of models by mean RMSE."""
    a, p = F.col("actual").cast("double"), F.col("predicted").cast("double")
    den = (F.abs(a) + F.abs(p)) / 2.0
    m = preds.groupBy(*by).agg(
        F.sqrt(F.avg((a - p) ** 2)).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"),
        (F.coalesce(F.avg(F.when(a != 0, F.abs((a - p) / a))), F.lit(0.0)) * 100).alias("mape"),
        (F.coalesce(F.avg(F.when(den > 0, F.abs(a - p) / den)), F.lit(0.0)) * 100).alias("smape"),
        F.count(F.lit(1)).alias("n"))
    return m


def forecast_timeline(series: DataFrame, horizon: int = 12) -> DataFrame:
    """Future time stamps per series: last ts + i · mean step, i = 1..horizon."""
    s = series.groupBy("series").agg(F.min("ts").alias("mn"), F.max("ts").alias("mx"), F.count(F.lit(1)).alias("n"))
    step = (F.unix_micros(F.col("mx").cast("timestamp")) - F.unix_micros(F.col("mn").cast("timestamp"))) / \
        F.greatest(F.col("n") - 1, F.lit(1))
    return s.select("series", "mx", step.alias("step_us"),
                    F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).select(
        "series", "h", F.timestamp_micros((F.unix_micros(F.col("mx").cast("timestamp"))
                                           + F.col("h") * F.col("step_us")).cast("long")).alias("ts"))


def _holt(y: np.ndarray, h: int) -> tuple[np.ndarray, float, float]:
    """Additive-trend exponential smoothing; (α, β) by one-step SSE on a grid; last value if too short.

    All pairs of the grid advance together, one vector step per observation.
    """
    if len(y) < 3:
        return np.repeat(y[-1] if len(y) else 0.0, h), float("nan"), float("nan")
    a, b = (g.ravel() for g in np.meshgrid(HOLT_GRID, HOLT_GRID, indexing="ij"))
    level, trend, sse = np.full(len(a), float(y[0])), np.full(len(a), float(y[1] - y[0])), np.zeros(len(a))
    for v in y[1:]:
        ahead = level + trend
        sse += (v - ahead) ** 2
        new = a * v + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * trend
        level = new
    i = int(np.argmin(sse))
    return level[i] + trend[i] * np.arange(1, h + 1), float(a[i]), float(b[i])


def _grid() -> tuple[np.ndarray, np.ndarray]:
    a, b = (g.ravel() for g in np.meshgrid(HOLT_GRID, HOLT_GRID, indexing="ij"))
    return a, b


def _advance(y: np.ndarray, level: np.ndarray, trend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend and one-step squared error after the observations, for every pair of the grid (last axis)."""
    a, b = _grid()
    sse = np.zeros(np.broadcast(level, a).shape)
    for v in y:
        ahead = level + trend
        sse += (v - ahead) ** 2
        new = a * v + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * trend
        level = new
    return level, trend, sse


def holt_map(y: np.ndarray) -> np.ndarray:
    """The chunk as an affine map of (level, trend): images of (0, 0), (1, 0), (0, 1), by pair of the grid.

    The images of the unit vectors are those under observations of zero, so that large values of the
    series cancel nowhere.
    """
    n = len(HOLT_GRID) ** 2
    unit = _advance(np.zeros(len(y)), np.array([[1.0], [0.0]]) * np.ones(n), np.array([[0.0], [1.0]]) * np.ones(n))
    zero = _advance(y, np.zeros(n), np.zeros(n))
    return np.stack([np.stack(zero[:2]), *np.stack(unit[:2], axis=1)])  # (3, level and trend, pairs)


def forecast_holt(folds: DataFrame, chunk: int = HOLT_CHUNK) -> DataFrame:
    """Holt forecasts for every (series, fold) test window.

    A step is an affine map of (level, trend), so chunks of a series are mapped in parallel, the maps
    of a series (a few kB a chunk) are composed to the state at every chunk's beginning, and errors per
    grid pair are summed over chunks in a second pass.  The pair of least error forecasts; fewer than
    three observations repeat the last one.
    """
    key = ["series", "fold"]
    rows = folds.select(F.col("series").cast("string").alias("series"), F.col("fold").cast("long").alias("fold"),
                        F.col("pos").cast("long").alias("pos"), "role", F.col("ts").cast("date").alias("ts"), F.col("y").cast("double").alias("y"))
    train = rows.where(F.col("role") == "train")
    facts = train.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max_by("y", "pos").alias("last"),
                                    F.max(F.when(F.col("pos") == 1, F.col("y"))).alias("first"),
                                    F.max(F.when(F.col("pos") == 2, F.col("y"))).alias("second"))
    steps = (train.where(F.col("pos") >= 2)
             .select(*key, F.floor((F.col("pos") - 2) / chunk).cast("long").alias("chunk"), "pos", "y"))

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("pos").y.to_numpy(float)
        return pd.DataFrame({"series": pdf.series.iloc[:1], "fold": pdf.fold.iloc[:1], "chunk": pdf.chunk.iloc[:1], "map": [holt_map(y).tobytes()]})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        n = len(HOLT_GRID) ** 2
        level, trend = np.full(n, pdf["first"].iloc[0]), np.full(n, pdf["second"].iloc[0] - pdf["first"].iloc[0])
        states = []
        for packed in pdf["map"]:
            states.append(np.stack([level, trend]).tobytes())
            zero, one, two = np.frombuffer(packed).reshape(3, 2, n)
            level, trend = zero + one * level + two * trend
        return pd.DataFrame({"series": pdf.series, "fold": pdf.fold, "chunk": pdf.chunk, "state": states})

    def errors(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        n = len(HOLT_GRID) ** 2
        level, trend = np.frombuffer(state.state.iloc[0]).reshape(2, n)
        level, trend, sse = _advance(pdf.sort_values("pos").y.to_numpy(float), level, trend)
        return pd.DataFrame({"series": pdf.series.iloc[0], "fold": pdf.fold.iloc[0], "chunk": pdf.chunk.iloc[0],
                             "pair": np.arange(n), "sse": sse, "level": level, "trend": trend})

    keys = "series string, fold long, chunk long"
    maps = steps.groupBy(*key, "chunk").applyInPandas(mapped, f"{keys}, map binary")
    states = (maps.join(facts.where(F.col("n") >= 3).select(*key, "first", "second"), key)
              .groupBy(*key).applyInPandas(composed, f"{keys}, state binary"))
    by_chunk = (steps.join(states.select(*key, "chunk"), [*key, "chunk"], "left_semi").groupBy(*key, "chunk")
                .cogroup(states.groupBy(*key, "chunk")).applyInPandas(errors, f"{keys}, pair long, sse double, level double, trend double"))
    pairs = by_chunk.groupBy(*key, "pair").agg(F.sum("sse").alias("sse"), F.max_by("level", "chunk").alias("level"),
                                               F.max_by("trend", "chunk").alias("trend"))
    best = pairs.groupBy(*key).agg(F.min_by(F.struct("level", "trend"), F.struct("sse", "pair")).alias("best"))
    test = rows.where(F.col("role") == "test").join(facts.select(*key, "n", "last"), key, "left").join(best, key, "left")
    ahead = F.col("best.level") + F.col("best.trend") * (F.col("pos") - F.col("n"))
    return test.select(*key, "pos", "ts", F.col("y").alias("actual"), F.coalesce(ahead, "last", F.lit(0.0)).alias("predicted"),
                       F.lit("holt").alias("model"))


def lag_rows(series: DataFrame, lags: int) -> DataFrame:
    return fe_lags(series.withColumn("y", F.col("y").cast("double")), "y", "ts", lags, ["series"])


def forecast_lag_ridge(series: DataFrame, lags: int = 12, horizon: int = 12, reg: float = 1.0) -> DataFrame:
    """One ridge model over all series' lag rows; recursive ``horizon``-step forecasts per series
    (``applyInPandas`` with the fitted coefficients shipped in the closure — a few floats)."""
    rows = lag_rows(series, lags)
    cols = [f"lag_{i}" for i in range(1, lags + 1)]
    va = VectorAssembler(inputCols=cols, outputCol="features")
    n = rows.count()
    model = LinearRegression(regParam=reg / max(n, 1), elasticNetParam=0.0, labelCol="y").fit(va.transform(rows))
    coef, icpt = model.coefficients.toArray().tolist(), float(model.intercept)
    w = Window.partitionBy("series").orderBy(F.desc("ts"))
    tail = series.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= lags)

    def rec(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = list(pdf.sort_values("ts").y.astype(float))
        out = []
        for hh in range(1, horizon + 1):
            x = hist[::-1][:lags]
            x += [x[-1] if x else 0.0] * (lags - len(x))
            yhat = icpt + float(np.dot(coef, x))
            out.append(yhat)
            hist.append(yhat)
        return pd.DataFrame({"series": pdf.series.iloc[0], "h": range(1, horizon + 1), "predicted": out,
                             "model": "lag_ridge"})
    return tail.groupBy("series").applyInPandas(rec, "series string, h long, predicted double, model string")


def forecast_lag_gbm(series: DataFrame, lags: int = 12, horizon: int = 12, max_iter: int = 100) -> DataFrame:
    """Direct multi-step GBT: one model per horizon h on (lags -> y shifted by h)."""
    rows = kept(lag_rows(series, lags))  # read once per horizon
    cols = [f"lag_{i}" for i in range(1, lags + 1)]
    w = Window.partitionBy("series").orderBy("ts")
    va = VectorAssembler(inputCols=cols, outputCol="features")
    # the newest lag vector of each series is the input for every horizon
    latest = series.withColumn("y", F.col("y").cast("double")).select(
        "series", "ts", *[F.lag("y", i - 1).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)])
    wl = Window.partitionBy("series").orderBy(F.desc("ts"))
    latest = latest.withColumn("__r", F.row_number().over(wl)).where(F.col("__r") == 1).dropna()
    out = None
    for h in range(1, horizon + 1):
        tgt = rows.withColumn("target", F.lead("y", h - 1).over(w)).dropna(subset=["target"])
        m = GBTRegressor(labelCol="target", maxIter=max_iter, maxDepth=3, seed=42).fit(va.transform(tgt))
        p = m.transform(va.transform(latest)).select("series", F.lit(h).cast("long").alias("h"),
                                                      F.col("prediction").alias("predicted"))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("model", F.lit("lag_gbm"))


def lag_candidates(lags: int, n: int, reg: float = 1.0, max_iter: int = 100) -> dict:
    """Pipelines from lag columns: ridge on scaled lags, and boosting."""
    va = VectorAssembler(inputCols=[f"lag_{i}" for i in range(1, lags + 1)], outputCol="features")
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    ridge = LinearRegression(featuresCol="scaled", labelCol="y", regParam=reg / max(n, 1), elasticNetParam=0.0, standardization=False)
    return {"lag_ridge": Pipeline(stages=[va, scale, ridge]),
            "lag_gbm": Pipeline(stages=[va, GBTRegressor(labelCol="y", maxIter=max_iter, maxDepth=3, seed=42)])}


def backtest_lag_models(series: DataFrame, lags: int = 12, n_splits: int = 5, max_iter: int = 100) -> DataFrame:
    """Expanding-window back-test of the lag models, in the shape of ``forecast_naive``.

    Folds are taken over the rows that have all lags; each test row is forecast one step ahead from
    its own lags, by one model per fold over all series.
    """
    wide = kept(lag_rows(series, lags))
    roles = backtest_frame(wide.select("series", "ts", "y"), n_splits).select("series", "ts", "fold", "pos", "role")
    rows = kept(wide.join(roles, ["series", "ts"]))
    sizes = {r.fold: r["count"] for r in rows.where("role = 'train'").groupBy("fold").count().collect()}

    def forecast(item: tuple) -> DataFrame:
        fold, name = item
        here = rows.where(F.col("fold") == fold)
        train = here.where(F.col("role") == "train").coalesce(-(-sizes[fold] // ROWS_A_TASK))
        model = lag_candidates(lags, sizes[fold], max_iter=max_iter)[name].fit(train)
        return model.transform(here.where(F.col("role") == "test")).select(
            "series", "fold", "pos", "ts", F.col("y").alias("actual"), F.col("prediction").alias("predicted"),
            F.lit(name).alias("model"), F.lit(1).cast("long").alias("horizon"))

    items = [(fold, name) for fold in sorted(sizes) for name in lag_candidates(lags, 1)]
    parts = concurrently(series.sparkSession, forecast, items)
    if not parts:
        return rows.select("series", "fold", "pos", "ts", F.col("y").alias("actual"), F.lit(None).cast("double").alias("predicted"),
                           F.lit(None).cast("string").alias("model"), F.lit(1).cast("long").alias("horizon")).limit(0)
    return kept(reduce(DataFrame.unionByName, parts))


def forecast_board(preds: DataFrame) -> DataFrame:
    """Models ranked by their mean RMSE over series and folds, as the reference ranks candidates.

    ``horizon`` is the most steps that a model looked ahead: forecasts of one step from true lags (horizon 1) are an
    easier task than those of a whole test window, so ranks compare alike only at equal horizons.  A forecast without a
    horizon of its own was made for the whole window of its fold.
    """
    per = forecast_backtest(preds, ["model", "series", "fold"])
    mean = per.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "mape", "smape")])
    own = F.col("horizon") if "horizon" in preds.columns else F.lit(None).cast("long")
    window = preds.select("model", "series", "fold", own.alias("own")).groupBy("model", "series", "fold").agg(
        F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
    ahead = window.groupBy("model").agg(F.max(F.coalesce("own", "n")).cast("long").alias("horizon"))
    rank = F.row_number().over(Window.orderBy("rmse", "model")).cast("long")  # one row per model
    return mean.join(ahead, "model").withColumn("rank", rank)
