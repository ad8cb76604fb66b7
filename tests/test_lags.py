from pyspark.sql import functions as F

from tabwork.operators.features import fe_lags


def test_join_lags_equal_window_lags(spark):
    rows = [(s, d, float((d * 7 + s) % 11)) for s in range(3) for d in range(40 if s else 200)]
    df = spark.createDataFrame(rows, "series int, day int, y double").repartition(5)
    cols = ["series", "day", "lag_1", "lag_2", "lag_3"]
    a = sorted(map(tuple, fe_lags(df, "y", "day", 3, ["series"]).select(*cols).collect()))
    b = sorted(map(tuple, fe_lags(df, "y", "day", 3, ["series"], method="join").select(*cols).collect()))
    assert a == b and len(a) == 200 + 40 + 40 - 9
    one = df.where(F.col("series") == 0).drop("series")
    c = sorted(map(tuple, fe_lags(one, "y", "day", 2).select("day", "lag_1", "lag_2").collect()))
    d = sorted(map(tuple, fe_lags(one, "y", "day", 2, method="join").select("day", "lag_1", "lag_2").collect()))
    assert c == d
