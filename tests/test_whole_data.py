"""No column, class or row is dropped silently, and results do not depend on the partitioning."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabwork.operators import eda, evaluate, features, pii, profile, workspace
from tabwork.operators.train import unsupervised
from tabwork.functions.ordered import bucket_of


def test_correlation_covers_every_column(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 30))
    x[:, 29] = 2 * x[:, 28]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], [f"c{i}" for i in range(30)])
    cols = df.columns
    high = eda.eda_high_correlation(eda.eda_correlation_matrix(df, cols), cols).collect()
    assert [(h.col_a, h.col_b) for h in high] == [("c28", "c29")]
    mi = eda.eda_mutual_information(df.withColumn("t", F.col("c0")), "t")
    assert mi.count() == 30


def test_imbalance_counts_all_classes(spark):
    rows = [(f"k{i}",) for i in range(31) for _ in range(1 + 40 * (i == 0))]
    df = spark.createDataFrame(rows, "t string")
    assert eda.eda_issue_imbalance(eda.eda_target_counts(df, "t"), "t").collect() == []
    few = df.where("t in ('k0', 'k1', 'k2')")
    assert eda.eda_issue_imbalance(eda.eda_target_counts(few, "t"), "t").first().metric == 41.0


def test_forest_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    x[:5] += 8
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    df = df.select("id", array_to_vector("x").alias("features"))
    a, b = ({r.id: r.score for r in unsupervised.isolation_forest(df.repartition(n), "id", n_trees=20, sample=64).collect()}
            for n in (3, 7))
    assert a == b and len(a) == 3000
    assert set(range(5)) <= set(sorted(a, key=a.get)[-10:])


def test_scaled_vectors_use_the_population_deviation(spark):
    x = np.random.default_rng(2).normal(3, 2, size=(50, 3))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    got = {r.id: r.features.toArray() for r in unsupervised.scaled_vectors(df, "id", "x").collect()}
    want = (x - x.mean(0)) / x.std(0)
    assert np.allclose([got[i] for i in range(50)], want)


def test_only_valid_cards_are_redacted(spark):
    df = spark.createDataFrame([(1, "pay 4111 1111 1111 1111 now"), (2, "no 4111 1111 1111 1112 card"), (3, None)], "id long, t string")
    got = {r.id: r for r in pii.pii_text_redact(df, "t", keep=["id"]).collect()}
    assert got[1].credit_card_count == 1 and got[1].redacted == "pay [CREDIT_CARD] now"
    assert got[2].credit_card_count == 0 and got[2].redacted == "no 4111 1111 1111 1112 card"
    assert got[3].redacted is None


def test_hashes_are_salted_and_tokens_wide(spark):
    df = spark.createDataFrame([("123-45-6789",)], "ssn string")
    with pytest.raises(ValueError):
        pii.pii_apply_hash(df, ["ssn"], "")
    with pytest.raises(ValueError):
        pii.pii_apply_pseudonymize(df, ["ssn"], "")
    for how in ("hash", "pseudonymize", "encrypt"):
        with pytest.raises(ValueError):
            pii.pii_apply(df, {"ssn": how})
    assert pii.pii_apply(df, {"ssn": "mask"}).first().ssn != "123-45-6789"
    token = pii.pii_apply_pseudonymize(df, ["ssn"], "k").first().ssn
    assert len(token) == len("SSN_") + 32
    assert pii.pii_apply(df, {"ssn": "hash"}, key="k").first().ssn != pii.pii_apply(df, {"ssn": "hash"}, key="l").first().ssn


def test_duplicates_compare_nested_columns_and_null_places(spark):
    df = spark.createDataFrame([(1, ["a"], None, "x"), (1, ["b"], None, "x"), (1, ["a"], None, "x"), (1, ["a"], "x", None),
                                (1, ["a", None], None, "x"), (1, [None, "a"], None, "x")], "i int, a array<string>, s string, t string")
    assert profile.profile_dataset(df).first().duplicate_rows == 1


def test_feed_honours_its_limit(spark):
    audit = spark.range(300).selectExpr("id", "id AS created_at", "1 AS project_id")
    assert workspace.activity_feed(audit, 250).count() == 250
    with pytest.raises(ValueError):
        workspace.activity_feed(audit, 0)


def test_curves_of_continuous_scores(spark):
    r = np.random.default_rng(3)
    rows = [(m, float(y), float(p)) for m in ("a", "b") for y, p in zip(r.integers(0, 2, 400), r.random(400).round(2))]
    scored = spark.createDataFrame(rows, "model string, label double, probability double")
    area = {x.model: x.pr_auc for x in evaluate.eval_pr_auc(scored, ["model"]).collect()}
    auc = {x.model: x.auc for x in evaluate.eval_auc_roc(scored, ["model"]).collect()}
    curve = evaluate.eval_roc_curve(scored, ["model"]).collect()
    for m in ("a", "b"):
        y = np.array([v for k, v, _ in rows if k == m])
        p = np.array([s for k, _, s in rows if k == m])
        cuts = sorted(set(p), reverse=True)
        rec = [0.0] + [y[p >= c].sum() / y.sum() for c in cuts]
        pre = [1.0] + [y[p >= c].sum() / (p >= c).sum() for c in cuts]
        assert abs(area[m] - sum(abs(rec[i + 1] - rec[i]) * (pre[i + 1] + pre[i]) / 2 for i in range(len(cuts)))) < 1e-9
        wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0])
        assert abs(auc[m] - wins / ((y == 1).sum() * (y == 0).sum())) < 1e-9
        mine = sorted((x.fpr, x.tpr) for x in curve if x.model == m)
        assert len(mine) == len(cuts) + 1 and mine[0] == (0.0, 0.0) and mine[-1] == (1.0, 1.0)
        assert sum(x.score is None for x in curve if x.model == m) == 1


def test_bucket_of_is_a_count_of_smaller_bounds(spark):
    bounds = [0.0, 1.0, 1.5, 7.0, 9.0]
    got = spark.range(100).select((F.col("id") / 10).alias("x")).select("x", bucket_of(F.col("x"), bounds).alias("b")).collect()
    assert all(r.b == sum(v < r.x for v in bounds) for r in got)
    assert spark.range(1).select(bucket_of(F.col("id").cast("double"), []).alias("b")).first().b == 0


def test_one_hot_takes_any_number_of_categories(spark):
    df = spark.range(150).selectExpr("id", "CASE WHEN id < 140 THEN concat('k', id) END AS c")
    wide = df.select("id", *features.fe_one_hot(df, "c", "c"))
    assert len(wide.columns) == 142 and wide.where("c_missing = 1").count() == 10
    with pytest.raises(ValueError):
        features.fe_one_hot(df, "c", "c", limit=100)
    vector = features.fe_one_hot_vector(df, "c", "v").collect()
    assert all(r.v.size == 141 and r.v.numNonzeros() == 1 for r in vector)


def test_ordered_fill_within_and_without_keys(spark):
    import random

    from tabwork.functions.ordered import fill_nulls_ordered

    r = random.Random(0)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, None, float(i)])) for i in range(400)]
    df = spark.createDataFrame(rows, "o long, k string, v double").repartition(5)
    for part in ([], ["k"]):
        for backward in (False, True):
            got = {x.o: x.v for x in fill_nulls_ordered(df, "v", "o", part, backward, n_buckets=7).collect()}
            last, want = {}, {}
            for o, k, v in sorted(rows, reverse=backward):
                key = k if part else 0
                last[key] = v if v is not None else last.get(key)
                want[o] = last[key]
            assert got == want


def test_cards_are_redacted_by_place(spark):
    card = "4111111111111111"
    texts = [f"{card}", f"a {card} b 9{card}9 c", f"{card} {card}", f"no 4111111111111112 but {card}.", "", None, "none"]
    got = [r.redacted for r in pii.pii_text_redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1), "t", ["id"]).orderBy("id").collect()]
    assert got[0] == "[CREDIT_CARD]" and got[2] == "[CREDIT_CARD] [CREDIT_CARD]"
    # the longer number is no card; what later entities make of it is theirs
    assert got[1].count("[CREDIT_CARD]") == 1 and got[1].startswith("a [CREDIT_CARD] b ") and got[1].endswith("9 c")
    assert got[3].endswith("but [CREDIT_CARD].") and got[4:] == ["", None, "none"]
