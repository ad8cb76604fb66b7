import random

from tabwork.operators.features import label_codes


def test_label_codes_across_many_sorted_partitions(spark):
    rng = random.Random(3)
    rows = [(f"v{rng.randrange(4000):05d}", f"w{rng.randrange(300):03d}") for _ in range(6000)] + [(None, "w000")]
    df = spark.createDataFrame(rows, "a string, b string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # keep 8 range partitions
    try:
        got = {(r.column_name, r.value): r.code for r in label_codes(df, ["a", "b"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for col, idx in (("a", 0), ("b", 1)):
        vals = sorted({(r[idx] if r[idx] is not None else "missing") for r in rows})
        assert [got[(col, v)] for v in vals] == list(range(len(vals)))
