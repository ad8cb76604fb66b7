import math

from pyspark.sql import functions as F

from tabwork.operators import profile as P


def _rows(df, key="column_name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_basic_profile_shape(spark):
    df = spark.createDataFrame(
        [(25.0, "NY", 1.0), (None, "LA", 2.0), (35.0, "NY", 3.0), (45.0, "SF", 4.0), (55.0, "NY", 5.0)],
        "age double, city string, score double")
    ds = P.profile_dataset(df).first()
    assert ds["row_count"] == 5 and ds["col_count"] == 3
    assert ds["missing_cells"] == 1
    cols = _rows(P.profile_columns(df))
    assert set(cols) == {"age", "city", "score"}
    assert cols["city"]["inferred_type"] == "categorical"
    assert cols["city"]["unique_count"] == 3


def test_numeric_stats_match_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "val double")
    r = _rows(P.profile_columns(df))["val"]
    s = pd.Series(vals)
    assert math.isclose(r["mean"], s.mean())
    assert math.isclose(r["std"], s.std())
    assert math.isclose(r["skewness"], s.skew(), rel_tol=1e-9)
    assert math.isclose(r["kurtosis"], s.kurtosis(), rel_tol=1e-9)
    assert r["min"] == 1.0 and r["max"] == 10.0


def test_nan_counts_as_missing_and_warning(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (None,), (None,), (1.0,)], "col double")
    r = _rows(P.profile_columns(df))["col"]
    assert r["n_missing"] == 4
    assert "High missing values" in r["warnings"]


def test_top_values_ties_broken_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "cat string")
    top = [(r["value"], r["count"], r["rank"]) for r in
           P.profile_top_values(df).orderBy("rank").collect()]
    assert top == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3)]


def test_histogram_last_bin_closed_and_constant(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] , "x double")
    h = P.profile_histogram(df, bins=10).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1] * 9 + [2]
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h2 = P.profile_histogram(const, bins=10).collect()
    assert sum(r["count"] for r in h2) == 2


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b string")
    ds = P.profile_dataset(df).first()
    assert ds["row_count"] == 0 and ds["duplicate_rows"] == 0
    cols = _rows(P.profile_columns(df))
    assert cols["a"]["unique_count"] == 0


def test_duplicates_and_string_dates(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 1), ("2024-02-03", 2)], "d string, n int")
    assert P.profile_dataset(df).first()["duplicate_rows"] == 1
    cols = _rows(P.profile_columns(df))
    assert cols["d"]["inferred_type"] == "datetime"
    years = spark.createDataFrame([("2024",), ("12",)], "y string")
    assert _rows(P.profile_columns(years))["y"]["inferred_type"] == "categorical"


def test_values_longer_than_their_head(spark):
    from collections import Counter

    from tabwork.operators import profile as P
    long = "x" * 40
    texts = [long + "b", long + "a", long + "a", "x" * 32, "short", "short", None, "", long + "c", "é" * 33, "é" * 32]
    df = spark.createDataFrame([(t, i % 3, float(i), f"only {i:02d} " + long) for i, t in enumerate(texts)], "s string, n int, count double, `a.b` string")
    want = Counter(t for t in texts if t is not None)
    assert {r.column_name: r.unique_count for r in P.profile_unique(df).collect()} == {"s": len(want), "n": 3, "count": 11, "a.b": 11}
    for k in (1, 2, 4, 20):
        got = [(r.value, r["count"]) for r in P.profile_top_values(df, k).where("column_name = 's'").orderBy("rank").collect()]
        assert got == sorted(want.items(), key=lambda r: (-r[1], r[0].encode()))[:k]
    first = P.profile_top_values(df, 3).where("column_name = 'a.b'").orderBy("rank").collect()
    assert [r.value for r in first] == [f"only {i:02d} " + long for i in range(3)]


def test_whole_texts_are_not_shuffled(spark):
    from tabwork.operators import profile as P
    df = spark.createDataFrame([("t" * 5000 + str(i),) for i in range(300)], "s string")
    counted = P.value_counts(df).agg({"head": "max", "h1": "count"}).first()
    assert len(counted["max(head)"]) == P.HEAD and counted["count(h1)"] == 300


def test_value_counts_of_native_types_have_the_texts_of_the_values(spark):
    """Grouped as they are, values are told apart just as by their texts: negative zero, NaN, dates, booleans."""
    import datetime
    from tabwork.operators.profile import value_counts
    rows = [(0.0, 1, True, datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5), "x" * 40),
            (-0.0, 1, None, datetime.date(2020, 1, 2), None, "x" * 40), (0.0, 300, False, None, None, "y"),
            (float("nan"), None, True, None, None, None)]
    df = spark.createDataFrame(rows, "d double, i int, b boolean, t date, n timestamp_ntz, s string")
    df = df.withColumn("f", F.col("d").cast("float")).withColumn("m", F.col("i").cast("decimal(9,2)")).withColumn("l", F.col("i").cast("long"))
    for c in df.columns:
        text = F.substring(F.col(c).cast("string"), 1, 32).alias("head")
        want = df.where(~F.col(c).cast("string").isin("NaN")).groupBy(text).count().where("head is not null").collect()
        got = value_counts(df).where(F.col("column_name") == c).select("head", "count").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), c


def test_wide_statistics_are_several_small_aggregates(spark):
    """One aggregate over many columns is too long for the JVM to compile; each now reads a few columns."""
    from tabwork.operators.profile import STATS_AT_ONCE, column_stats
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(9)])
    got = {r.column_name: (r.n_rows, r.mean, r.max, r.position) for r in column_stats(df).collect()}
    assert got == {f"c{i}": (50, 24.5 * (i + 1), 49.0 * (i + 1), i) for i in range(9)}
    plan = column_stats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == -(-9 // STATS_AT_ONCE)


def test_texts_are_read_again_only_where_heads_were_cut(spark):
    from tabwork.operators.profile import value_counts, with_text
    df = spark.createDataFrame([("a", "b"), ("a", "c" * 50)], "short string, long string")
    counts = value_counts(df)
    short = with_text(df, counts.where("column_name = 'short'"))
    assert "Join" not in short._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.column_name, r.value) for r in with_text(df, counts).collect()} == {("short", "a"), ("long", "b"), ("long", "c" * 50)}


def _odd(spark):
    return spark.range(2_000).select(
        (F.col("id") % 700).alias("whole"), F.when(F.col("id") % 3 > 0, F.expr("CASE id % 5 WHEN 0 THEN -0.0D WHEN 1 THEN 0.0D WHEN 2 THEN double('NaN') ELSE id / 7 END")).alias("x"),
        F.expr("float(id % 4) * -0.0").alias("f"), F.expr("if(id % 9 = 0, null, concat(repeat('long ', 7), id % 11))").alias("s.t"),
        F.expr("cast(id % 6 as decimal(38, 2))").alias("d"), F.expr("timestamp_seconds(id % 13)").alias("ts"), F.expr("date_add(date'2020-01-01', int(id % 17))").alias("day"),
        (F.col("id") % 2 == 0).alias("b"), F.expr("encode('x', 'UTF-8')").alias("bytes"), F.lit(None).cast("int").alias("none"))


def test_columns_counted_one_by_one_equal_those_counted_together(spark, monkeypatch):
    """A narrow table is not multiplied by its columns before the counting; a wide one still is, with the same counts."""
    df = _odd(spark)
    alone, plan = P.value_counts(df), P.value_counts(df)._jdf.queryExecution().executedPlan().toString()
    one = sorted(map(tuple, alone.collect()))
    monkeypatch.setattr(P, "COUNTS_SCANS", 0)
    both = P.value_counts(df)
    assert "Expand" not in plan and "Expand" in both._jdf.queryExecution().executedPlan().toString()
    assert one == sorted(map(tuple, both.collect())) and {r[0] for r in one} == set(df.columns) - {"none", "bytes"}


def test_only_values_as_frequent_as_the_last_wanted_are_ranked(spark, monkeypatch):
    df = spark.range(5_000).select(F.when(F.col("id") < 900, F.col("id") % 9).otherwise(F.col("id")).alias("k"), F.col("id").alias("u"))
    ranked, rank = [], P.top_k_per_group
    monkeypatch.setattr(P, "top_k_per_group", lambda d, *a: (ranked.append(d), rank(d, *a))[1])
    top = P.profile_top_values(df, k=4).orderBy("column_name", "rank").collect()
    assert [(r.column_name, r.value, r["count"]) for r in top] == (
        [("k", str(i), 100) for i in range(4)] + [("u", v, 1) for v in ("0", "1", "10", "100")])
    assert ranked[0].where("column_name = 'k'").count() == 9
