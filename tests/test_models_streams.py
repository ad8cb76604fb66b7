import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from tabwork.operators import explain as X
from tabwork.operators.train import unsupervised as U


def test_entry_and_registry(spark):
    out = E.entry(spark)
    assert out.count() > 0 and "column_name" in out.columns
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 200


def test_shapley_additivity(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(2 * a - b + rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LinearRegression(labelCol="y")]).fit(df)
    phi = X.explain_sampled_shapley(model, df.select("id", "a", "b"), ["a", "b"], "id", n_permutations=3)
    tot = phi.groupBy("id").agg(F.sum("contribution").alias("s"))
    base = X.explain_base_value(model, df, ["a", "b"])
    pred = model.transform(df).select("id", "prediction")
    chk = tot.join(pred, "id").select(F.max(F.abs(F.col("s") - (F.col("prediction") - base)))).first()[0]
    assert chk < 1e-9


def test_isolation_forest_ranks_planted_outliers(spark):
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(400, 3)).tolist() + [[8.0, 8.0, 8.0], [-9.0, 7.0, 9.0]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "id long, x array<double>")
    v = df.select("id", array_to_vector("x").alias("features"))
    s = U.isolation_forest(v, "id", n_trees=40, sample=128).toPandas()
    assert s.score.between(0, 1).all()
    top = set(s.sort_values("score", ascending=False).id.head(2))
    assert top == {400, 401}


def test_stream_equals_batch(spark, sf):
    from tabwork.catalog import streams
    from tabwork.session import table
    got = {r.hour: r["count"] for r in streams.q_monitor_volume_stream(spark, sf).collect()}
    ev = table(spark, sf, "events")
    exp = {r.h: r.c for r in ev.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("h"))
           .agg(F.count(F.lit(1)).alias("c")).collect()}
    assert got == exp


def _append_vs_complete(spark, sf, time_col):
    from tabwork.catalog.streams import _log_folder
    from tabwork.streaming import monitor as SM
    path, schema = _log_folder(spark, sf, "events", time_col=time_col)
    out, ckpt = SM.stream_dirs(spark, "append")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    agg = SM.hourly_volume(src, "ts").select(F.col("w.start").alias("start"), "count")
    SM.run_append_to_parquet(agg, out, ckpt)
    appended = {r.start: r["count"] for r in spark.read.parquet(out).collect()}
    complete = {r.w.start: r["count"] for r in SM.monitor_volume_stream(spark, path, schema, ts_col="ts").collect()}
    return appended, complete


def test_append_mode_is_subset_of_complete(spark, sf):
    """Append emits a window once the watermark passes it (the newest stay open) and drops
    rows that arrive behind the watermark; complete mode keeps every row.  For any file
    order the appended windows are a subset and never count more."""
    for time_col in ("ts", None):
        appended, complete = _append_vs_complete(spark, sf, time_col)
        assert appended and set(appended) < set(complete)
        assert all(v <= complete[k] for k, v in appended.items())
