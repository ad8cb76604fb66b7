import numpy as np
import pandas as pd

from tabwork.functions.quantiles import exact_quantiles
from tabwork.operators.profile import profile_quantiles


def test_distributed_exact_quantiles_match_pandas(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 20, 1000).astype(float)      # heavy ties
    b = rng.normal(size=1000)
    b[::10] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf).repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    for c in ("a", "b"):
        for p in probs:
            assert abs(got[(c, p)] - pdf[c].dropna().quantile(p)) < 1e-9


def test_profile_quantiles_distributed_path(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 3, 9, 2]], "x double")
    spark.conf.set("tabwork.quantile.exactMaxBytes", "0")
    try:
        got = {r.p: r.value for r in profile_quantiles(df, ["x"]).collect()}
    finally:
        spark.conf.unset("tabwork.quantile.exactMaxBytes")
    s = pd.Series([5, 1, 3, 3, 9, 2], dtype=float)
    assert all(abs(got[p] - s.quantile(p)) < 1e-12 for p in (0.25, 0.5, 0.75))
