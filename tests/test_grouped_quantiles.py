from pyspark.sql import functions as F

from tabwork.operators import monitor as M
from tabwork.session import table


def _rows(df, key):
    return {r[key]: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in df.columns if c != key)
            for r in df.collect()}


def test_rate_quantiles_distributed_equals_exact(spark, sf):
    ev = table(spark, sf, "events")
    exact = _rows(M.monitor_rate_quantiles(ev, "value", "ts", F.col("event_type") == "error"), "window_start")
    spark.conf.set("tabwork.quantile.exactMaxBytes", "0")
    try:
        dist = _rows(M.monitor_rate_quantiles(ev, "value", "ts", F.col("event_type") == "error"), "window_start")
    finally:
        spark.conf.unset("tabwork.quantile.exactMaxBytes")
    assert exact == dist and len(exact) > 0


def test_pdp_distributed_equals_exact(spark, sf):
    from pyspark.ml.feature import SQLTransformer
    from tabwork.operators.explain import explain_pdp
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount")
    model = SQLTransformer(statement="SELECT *, 0.5 * l_quantity + 100 * l_discount AS prediction FROM __THIS__")
    exact = _rows(explain_pdp(model, li, "l_quantity", 5), "point")
    spark.conf.set("tabwork.quantile.exactMaxBytes", "0")
    try:
        dist = _rows(explain_pdp(model, li, "l_quantity", 5), "point")
    finally:
        spark.conf.unset("tabwork.quantile.exactMaxBytes")
    assert exact == dist


def test_narrowed_quantiles_equal_the_exact_ones(spark):
    """Ties, negative zeros, infinities, a group of one, a group of nulls; and bounds that miss every wanted rank."""
    import pytest
    from tabwork.functions.quantiles import quantile_bounds, quantiles_between, quantiles_long
    inf = float("inf")
    rows = [("a", float(i % 7919)) for i in range(20_000)] + [("b", 5.0)] * 300 + [("c", 1.5), ("n", None)]
    rows += [("z", v) for v in (-0.0, 0.0, -inf, inf, 2.0)] + [("k", 3.0)] * 500 + [("k", float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.1, 0.5, 0.9]
    want = {(r.g, r.p): r.value for r in quantiles_long(df, ["g"], "v", probs).collect()}
    good = df.groupBy("g").agg(quantile_bounds("v", probs).alias("__b"))
    bad = df.groupBy("g").agg(F.array(*[F.lit(-9e9)] * 6).alias("__b")).where("g <> 'n'")
    for bounds in (good, bad):
        got = {(r.g, r.p): r.value for r in quantiles_between(df, bounds, ["g"], "v", probs).collect()}
        assert got == pytest.approx(want, nan_ok=True)


def test_pdp_shuffles_values_near_the_quantiles_only(spark, monkeypatch):
    """The whole exact plan over all predictions is not run while the bounds hold."""
    from pyspark.ml.feature import SQLTransformer
    from tabwork.functions import quantiles
    from tabwork.operators.explain import explain_pdp
    df = spark.range(20_000).select((F.col("id") % 50).cast("double").alias("x"), F.rand(3).alias("u"))
    model = SQLTransformer(statement="SELECT *, x + u AS prediction FROM __THIS__")
    seen = []
    of_counts = quantiles._of_counts
    monkeypatch.setattr(quantiles, "_of_counts", lambda vc, keys, probs: (seen.append((keys, vc)), of_counts(vc, keys, probs))[1])
    got = explain_pdp(model, df, "x", 3).collect()
    (vc,) = [v for k, v in seen if k == ["point", "grid_value"]]
    assert len(got) == 3 and vc.count() < 3_000


def test_pdp_scores_all_rows_once_and_a_sample_for_the_bounds(spark, monkeypatch):
    """Means and bands of all rows, also where the sample's bounds miss them; only the sample is scored twice."""
    import pytest
    from pyspark.ml.feature import SQLTransformer
    from tabwork.functions import quantiles
    from tabwork.operators import explain
    df = spark.range(6_000).select((F.col("id") % 50).cast("double").alias("x"), ((F.col("id") * 37) % 6_000).cast("double").alias("u"))
    model = SQLTransformer(statement="SELECT *, x + u AS prediction FROM __THIS__")
    bounded = []
    of_counts = quantiles._of_counts
    monkeypatch.setattr(quantiles, "_of_counts", lambda vc, keys, probs: (bounded.append(keys), of_counts(vc, keys, probs))[1])
    want = explain.explain_pdp(model, df, "x", 3).orderBy("point").collect()
    sampled, wide = [], quantiles.quantile_bounds_wide
    monkeypatch.setattr(quantiles, "quantile_bounds_wide", lambda *a: (sampled.append(a), wide(*a))[1])
    for rows, margin, missed in ((1_000, 0.2, 0), (1_000, 0.0, 1)):
        monkeypatch.setattr(explain, "BOUND_ROWS", rows)
        monkeypatch.setattr(explain, "BOUND_MARGIN", margin)
        sampled.clear()
        bounded.clear()
        got = explain.explain_pdp(model, df, "x", 3).orderBy("point").collect()
        assert len(sampled) == 1 and bounded.count(["point", "grid_value"]) == 1 + missed
        assert [(r.point, r.value, r.p10, r.p90) for r in got] == [(r.point, r.value, r.p10, r.p90) for r in want]
        assert [r.mean for r in got] == pytest.approx([r.mean for r in want])
        assert [r.mean for r in got] == pytest.approx([r.value + 2_999.5 for r in got])
