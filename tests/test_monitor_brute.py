import math

import numpy as np
import pandas as pd

from tabwork.operators import monitor as M
from tabwork.operators import profile as P


def _psi(base, cur, buckets=10):
    lo, hi = min(base.min(), cur.min()), max(base.max(), cur.max())
    if hi == lo:
        return 0.0
    step = (hi - lo) / buckets

    def fr(v):
        idx = np.minimum(((v - lo) / step).astype(int), buckets - 1)
        c = np.bincount(idx, minlength=buckets)
        return (c + 1e-6) / len(v)
    b, c = fr(base), fr(cur)
    return float(np.sum((c - b) * np.log(c / b)))


def _ks(a, b):
    xs = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


def _long(spark, name, vals):
    return spark.createDataFrame(pd.DataFrame({"feature": name, "value": vals.astype(str)}))


def test_psi_and_ks_match_numpy(spark):
    rng = np.random.default_rng(11)
    base = np.round(rng.normal(0, 1, 700), 3)
    cur = np.round(rng.normal(0.3, 1.2, 500), 3)
    b, c = _long(spark, "f", base), _long(spark, "f", cur)
    psi = M.psi_numeric(b, c).first().psi
    assert math.isclose(psi, _psi(base, cur), rel_tol=1e-9)
    ks = M.drift_ks(b, c).first().ks
    assert math.isclose(ks, _ks(base, cur), rel_tol=1e-12)


def test_categorical_psi_union_of_categories(spark):
    b = spark.createDataFrame([("f", "a")] * 6 + [("f", "b")] * 4, "feature string, value string")
    c = spark.createDataFrame([("f", "a")] * 5 + [("f", "c")] * 5, "feature string, value string")
    got = M.psi_categorical(b, c).first().psi
    eps = 1e-6
    exp = 0.0
    for cat, nb, nc in (("a", 6, 5), ("b", 4, 0), ("c", 0, 5)):
        pb, pc = (nb + eps) / 10, (nc + eps) / 10
        exp += (pc - pb) * math.log(pc / pb)
    assert math.isclose(got, exp, rel_tol=1e-9)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(12)
    x = rng.gamma(2.0, 3.0, 999)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = [r["count"] for r in P.profile_histogram(df, bins=10).orderBy("bin").collect()]
    exp, _ = np.histogram(x, bins=10)
    assert sum(got) == 999
    assert max(abs(a - b) for a, b in zip(got, exp)) <= 1   # edges equal up to float rounding


def test_uncertainty_scores(spark):
    df = spark.createDataFrame([([0.5, 0.5], 0.5), ([1.0, 0.0], 1.0), ([0.7, 0.2, 0.1], None), (None, 0.8)],
                               "probabilities array<double>, confidence double")
    rows = df.select(M.uncertainty_entropy(df.probabilities, df.confidence).alias("e"),
                     M.uncertainty_margin(df.probabilities, df.confidence).alias("m"),
                     M.uncertainty_confidence(df.confidence).alias("c")).collect()
    assert math.isclose(rows[0].e, 1.0, rel_tol=1e-9) and math.isclose(rows[0].m, 1.0)
    assert rows[1].e < 1e-9 and rows[1].m == 0.0
    assert math.isclose(rows[2].m, 1 - (0.7 - 0.2)) and rows[2].c == 0.0
    assert math.isclose(rows[3].e, 1 - 0.8) and math.isclose(rows[3].m, 1 - 0.8)
