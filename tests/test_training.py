"""Cross-validated training on tables as they come: texts, nulls, several classes."""
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabwork.operators import evaluate, sampling
from tabwork.operators.train import cv

FEATURES = ["x", "colour", "noise"]


def frame(spark, n=360, classes=3, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = i % classes
        colour = r.choice(["red", "blue"]) if k == 0 else ["green", "grey"][k - 1]
        rows.append((i, k + r.gauss(0, 0.3) if r.random() > 0.1 else None, colour if r.random() > 0.1 else None, r.random(),
                     f"class{k}", 3.0 * k + r.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "id long, x double, colour string, noise double, label string, y double")
    return sampling.folds_kfold(df, "id", k=3)


def small(monkeypatch):
    full = cv.classifiers, cv.regressors
    monkeypatch.setattr(cv, "classifiers", lambda n: full[0](n, trees=10, rounds=4))
    monkeypatch.setattr(cv, "regressors", lambda n: full[1](n, trees=10, rounds=4))


def test_default_sizes(spark):
    c, r = cv.classifiers(2), cv.regressors(10)
    assert c["gbt"].getMaxIter() == r["gbt"].getMaxIter() == 100
    assert c["random_forest"].getNumTrees() == r["random_forest"].getNumTrees() == 200


def test_text_and_null_features_and_class_probabilities(spark, monkeypatch):
    small(monkeypatch)
    df = frame(spark)
    lb, scored = cv.train_candidates(df, FEATURES, "label", "id", "fold")
    board = {r.model_name: r for r in lb.collect()}
    assert set(board) == {"gbt", "random_forest", "logistic_regression"}
    assert all(r.cv_score > 0.85 and r.train_score is not None for r in board.values())
    assert scored.count() == 3 * 360  # every row is scored once by every model
    sums = scored.select(F.size("probabilities").alias("n"), F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p).alias("s"))
    assert sums.where("n <> 3 or abs(s - 1) > 1e-6").count() == 0
    auc = evaluate.eval_auc_ovr(cv.class_scores(scored), ["model"]).collect()
    assert len(auc) == 9 and all(r.auc > 0.9 for r in auc)


def test_features_are_fitted_within_the_fold(spark):
    df = frame(spark).withColumn("fold", F.when(F.col("colour") == "grey", 1).otherwise(0))
    rows = cv.labelled(df, ["colour"], "label", "id", "fold", index_label=True)
    est = cv.Pipeline(stages=[*cv.feature_stages(rows, ["colour"]), cv.classifiers(3, 5, 2)["random_forest"]])
    model = est.fit(rows.where("fold = 0"))
    indexer = [s for s in model.stages if hasattr(s, "labels")][0]
    assert "grey" not in indexer.labels and model.transform(rows.where("fold = 1")).count() == df.where("fold = 1").count()


def test_regression_has_a_train_score(spark, monkeypatch):
    small(monkeypatch)
    lb, scored = cv.train_candidates(frame(spark), FEATURES, "y", "id", "fold", classification=False)
    assert all(r.train_score > 0.5 and r.cv_score > 0.5 for r in lb.collect())


def test_balancing_happens_inside_folds(spark, monkeypatch):
    small(monkeypatch)
    df = frame(spark, classes=2).where("label = 'class0' or id % 6 = 1")
    for how in ("class_weights", "undersample_random", "oversample_random"):
        lb, scored = cv.train_candidates(df, FEATURES, "label", "id", "fold", balance=how, models=["random_forest", "logistic_regression"])
        assert scored.groupBy("id", "model").count().where("count <> 1").count() == 0
        assert all(r.cv_score > 0.8 for r in lb.collect())
    with pytest.raises(ValueError):
        cv.train_candidates(df, FEATURES, "label", "id", "fold", balance="magic", models=["logistic_regression"])


def test_search_gives_every_trial_and_retrains_the_best(spark, monkeypatch):
    small(monkeypatch)
    df = frame(spark)
    trials = cv.tune_random_search(df, FEATURES, "label", "id", "fold", "logistic_regression", n_trials=7)
    assert trials.count() == 7 and trials.select("params").distinct().count() == 7
    lb, _ = cv.retrain_best(df, FEATURES, "label", "id", "fold", "logistic_regression", trials)
    assert lb.first().cv_score >= 0.8
    monkeypatch.setitem(cv.SEARCH_SPACE, "gbt", {"maxDepth": (2, 3, "int"), "maxIter": (2, 3, "int")})
    many = cv.tune_random_search(df, FEATURES, "label", "id", "fold", "gbt", n_trials=2)
    assert many.count() == 2 and many.first().cv_score > 0.6
    with pytest.raises(ValueError):
        cv.tune_random_search(df, FEATURES, "label", "id", "fold", "gbt", n_trials=0)


def test_text_weights_equal_the_formula_and_are_fitted_within_the_fold(spark):
    import numpy as np

    from tabwork.operators.train import text

    docs = spark.createDataFrame([(1, "red red blue", 0.0, 0), (2, "red green", 1.0, 0), (3, "red blue", 0.0, 0), (4, "only here only", 1.0, 1), (5, None, 0.0, 1)],
                                 "id long, t string, label double, fold int")
    rows = text.text_rows(docs, "t", "label", "id", "fold")
    model = text.SublinearTfidf(min_df=2).fit(rows.where("fold = 0"))
    vocab = model.counts.vocabulary
    assert set(vocab) == {"red", "blue", "red blue"}
    got = {r.id: r.features.toArray() for r in model.transform(rows).collect()}
    df = {"red": 3, "blue": 2, "red blue": 2}
    raw = np.array([(1 + np.log(2 if v == "red" else 1)) * (np.log(4 / (1 + df[v])) + 1) for v in vocab])
    assert np.allclose(got[1], raw / np.linalg.norm(raw)) and not got[4].any() and not got[5].any()


def test_synthetic_rows_inside_the_folds(spark):
    rows = spark.createDataFrame([(i, float(i % 11), float(i % 7) + (3 if i % 10 == 0 else 0), "big" if i % 10 == 0 else "usual", i % 3) for i in range(300)],
                                 "id long, a double, b double, label string, fold int")
    m = cv.labelled(rows, ["a", "b"], "label", "id", "fold", index_label=True)
    pipe = Pipeline(stages=[*cv.feature_stages(m, ["a", "b"]), LogisticRegression()])
    held = {}
    for how in (None, "oversample_smote", "oversample_adasyn"):
        got = cv.cv_out_of_fold(m, pipe, "m", "id", balance=how)
        assert got.scored.count() == 300 and sorted(got.train_scores) == [0, 1, 2]
        assert got.scored.select("id").distinct().count() == 300  # no synthetic row is scored
        held[how] = got.scored.where("label = 0 and prediction = 0").count()
    assert held["oversample_smote"] >= (held[None] or 0)
    fold = cv.folded(m, cv.feature_stages(m, ["a", "b"]), "fold", [0])[0]
    grown = cv.BALANCERS["oversample_smote"](fold.train, "label", "id")
    assert {r["count"] for r in grown.groupBy("label").count().collect()} == {180}
    fold.release()


def test_verdict_bands(spark):
    rows = [("random_forest", 0.7, 0.01, 0.82, 0.8, 0.76), ("gbt", 0.7, 0.06, 0.9, 0.7, 0.7), ("logistic_regression", 0.7, 0.03, 0.7, 0.62, 0.5), ("ridge", 0.5, None, None, None, None)]
    lb = spark.createDataFrame(rows, "model_name string, cv_score double, cv_std double, train_score double, auc_roc double, f1 double")
    got = {r.model_name: (r.strengths.split("; "), r.weaknesses.split("; ") if r.weaknesses else []) for r in cv.model_verdicts(lb).collect()}
    assert got["random_forest"][0][:3] == ["Very stable across folds (σ=1.0%)", "Good discrimination (AUC=0.800)", "Strong weighted F1"]
    assert got["random_forest"][1] == ["Mild overfitting — train-CV gap 12.0%", cv.NOTE_MEMORISES]
    assert got["gbt"][1] == ["Unstable fold scores (σ=6.0%) — check for data issues", "Strong overfitting — train-CV gap 20.0%"]
    assert "Moderate discrimination (AUC=0.700)" in got["gbt"][0]
    assert got["logistic_regression"] == (["No significant overfitting detected", *cv.FAMILY_STRENGTHS["logistic_regression"]],
                                          ["Low F1 — likely struggling with minority class", cv.NOTE_NON_LINEAR])
    assert got["ridge"][1] == []
    plain = cv.model_verdicts(lb.drop("auc_roc", "f1"), classification=False).collect()
    assert all(r.auc_roc is None and "discrimination" not in r.strengths + r.weaknesses for r in plain)


def test_candidates_for_texts_share_the_weights_of_a_fold(spark, monkeypatch):
    from tabwork.operators.train import text

    r = random.Random(5)
    docs = [(i, " ".join(r.choices(["good", "fine", "calm"] if i % 2 else ["bad", "loud", "worse"], k=6)) + " common words", float(i % 2)) for i in range(60)]
    df = sampling.folds_kfold(spark.createDataFrame(docs, "id long, t string, label double"), "id", k=3)
    fits, fit = [], text.SublinearTfidf._fit
    monkeypatch.setattr(text.SublinearTfidf, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    board, scored = text.train_text(df, "t", "label", "id", "fold")
    assert len(fits) == 3  # once a fold, for all candidates
    assert {b.model: b.cv_accuracy for b in board.collect()} == {"naive_bayes": 1.0, "logistic_regression": 1.0, "linear_svm": 1.0}
    assert scored.count() == 180 and "terms" not in scored.columns


def test_rows_stay_where_they_are_when_labels_get_codes(spark):
    """Joined without a hint, rows went to the task of their class: two classes, two tasks at most."""
    df = frame(spark, classes=2).repartition(6)
    rows = cv.labelled(df, FEATURES, "label", "id", "fold", index_label=True)
    assert rows.rdd.getNumPartitions() == 6
    assert {(r.label_str, r.label) for r in rows.collect()} == {("class0", 0.0), ("class1", 1.0)} and rows.count() == 360
    from tabwork.operators import features
    encoded = features.fe_label_encode(df, ["label", "colour"])
    assert encoded.rdd.getNumPartitions() == 6 and encoded.count() == 360


def test_many_codes_are_joined_without_a_hint(spark, monkeypatch):
    from tabwork.operators import features
    df = frame(spark, classes=2)
    want = sorted(features.fe_label_encode(df, ["label"]).select("id", "label").collect())
    monkeypatch.setattr(features, "BROADCAST_CODES", 1)
    assert sorted(features.fe_label_encode(df, ["label"]).select("id", "label").collect()) == want


def test_a_task_of_a_fit_holds_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(cv, "ROWS_A_TASK", 10)
    monkeypatch.setattr(cv, "MOST_ROWS_A_TASK", 50)
    rows, *_ = cv._rows_and_candidates(frame(spark).repartition(2), FEATURES, "label", "id", "fold", True)
    assert rows.rdd.getNumPartitions() == 8 and rows.count() == 360 and rows.select("id").distinct().count() == 360


def test_terms_end_where_their_weights_begin(spark):
    """They went through Python in both directions with every row, though nothing reads them any more."""
    from tabwork.operators.train import text

    rows = text.text_rows(spark.createDataFrame([(1, "red red blue", 0.0, 0), (2, "red blue", 1.0, 0)], "id long, t string, label double, fold int"), "t", "label", "id", "fold")
    weighted = text.SublinearTfidf(min_df=2).fit(rows).transform(rows)
    assert weighted.columns == ["id", "fold", "label", "features"]
