"""Cross-validated training on Spark ML (survey §2.10).

One out-of-fold job per candidate and fold writes the ``scored`` table
(id, label, prediction, probability, model, fold); every evaluation metric of
§2.11 is an aggregate over it, so nothing is refit for evaluation.  Imputation and encoding are
fitted on each fold's training rows, so a fold never sees the values of its held-out rows, and once:
all candidates and trials share a fold's vectors.  Fits are independent jobs of many small stages, so
FITS of them run at a time from driver threads, each in its own scheduler pool.  Folds come from
``sampling.folds_*`` (hash-based, repartition-proof).
"""
from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.columns import is_numeric, q
from ..evaluate import eval_accuracy, eval_auc_ovr, eval_auc_roc, eval_macro_weighted, eval_r2_rmse_mae
from ..features import few, label_codes
from ..neighbours import oversample_adasyn, oversample_smote
from ..sampling import class_weights, hash_share, oversample_random, undersample_random

SEED = 42
FITS = 8              # fits that run at a time
ROWS_A_TASK = 65_536  # fewer rows than this per partition make a fit wait for its tasks, not for its work
MOST_ROWS_A_TASK = 1 << 20  # more rows than this per partition make one task of a fit read too much


# ------------------------------------------------------------------ candidates
def classifiers(n_classes: int, trees: int = 200, rounds: int = 100) -> dict[str, Estimator]:
    """Boosted trees (binary; one-vs-rest above two classes), random forest, logistic regression."""
    gbt = GBTClassifier(maxIter=rounds, maxDepth=5, seed=SEED)
    return {
        "gbt": gbt if n_classes <= 2 else OneVsRest(classifier=gbt),
        "random_forest": RandomForestClassifier(numTrees=trees, seed=SEED),
        "logistic_regression": LogisticRegression(maxIter=100),
    }


def regressors(n_rows: int, trees: int = 200, rounds: int = 100, alpha: float = 1.0) -> dict[str, Estimator]:
    """Boosted trees, random forest, ridge (α/n regParam on unstandardised features = scikit-learn Ridge(α))."""
    return {
        "gbt": GBTRegressor(maxIter=rounds, maxDepth=5, seed=SEED),
        "random_forest": RandomForestRegressor(numTrees=trees, seed=SEED),
        "ridge": LinearRegression(elasticNetParam=0.0, regParam=alpha / max(n_rows, 1), standardization=False),
    }


# Stronger regularisation presets offered to fix over-fitting.
FIX_OVERFIT = {
    "gbt": {"maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 10},
    "random_forest": {"maxDepth": 6, "minInstancesPerNode": 10, "subsamplingRate": 0.8},
    "logistic_regression": {"regParam": 0.1},
    "ridge": {"regParam": 0.1},
}

# Random-search ranges per model: (least, most, scale).  Trials are drawn from the ranges, so any
# number of different trials can be asked for.
SEARCH_SPACE = {
    "gbt": {"maxDepth": (2, 8, "int"), "stepSize": (0.01, 0.3, "log"), "maxIter": (20, 200, "int"),
            "subsamplingRate": (0.6, 1.0, "linear")},
    "random_forest": {"numTrees": (50, 300, "int"), "maxDepth": (3, 15, "int"), "minInstancesPerNode": (1, 10, "int")},
    "logistic_regression": {"regParam": (1e-5, 10.0, "log"), "elasticNetParam": (0.0, 1.0, "linear")},
    "ridge": {"regParam": (1e-6, 1.0, "log")},
}


def params_fix_overfit(model_name: str) -> dict:
    return dict(FIX_OVERFIT.get(model_name, {}))


def with_params(est: Estimator, params: dict) -> Estimator:
    """A copy with the parameters set; of a pipeline its last stage, of one-vs-rest its classifier."""
    if isinstance(est, Pipeline):
        stages = est.getStages()
        return Pipeline(stages=[*stages[:-1], with_params(stages[-1], params)])
    if isinstance(est, OneVsRest):
        outer = {k: v for k, v in params.items() if est.hasParam(k) and not est.getClassifier().hasParam(k)}
        out = OneVsRest(classifier=with_params(est.getClassifier(), params))
        return out._set(**outer) if outer else out
    e = est.copy()
    for k, v in params.items():
        if e.hasParam(k):
            e._set(**{k: v})
    return e


# ------------------------------------------------------------------ matrix
def labelled(df: DataFrame, features: list[str], label: str, id_col: str, fold_col: str | None = None,
             index_label: bool = False) -> DataFrame:
    """Raw feature columns, numeric label (``label_str`` kept when indexed), id (and fold).

    Only rows without a label are left out.  Class codes are alphabetical and come from a
    distributed sort; the codes are joined back, not collected, and the rows stay where they are.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    feats = [F.col(q(f)).cast("double").alias(f) if is_numeric(kinds[f]) or isinstance(kinds[f], T.BooleanType)
             else F.col(q(f)).cast("string").alias(f) for f in features]
    keep = [F.col(q(id_col))] + ([F.col(q(fold_col))] if fold_col else [])
    out = df.where(F.col(q(label)).isNotNull())
    if not index_label:
        return out.select(*keep, *feats, F.col(q(label)).cast("double").alias("label"))
    out = out.select(*keep, *feats, F.col(q(label)).cast("string").alias("label_str"))
    codes = label_codes(out, ["label_str"]).select(F.col("value").alias("label_str"), F.col("code").cast("double").alias("label"))
    return out.join(few(codes), "label_str")


def feature_stages(rows: DataFrame, features: list[str]) -> list:
    """Pipeline stages from raw columns to ``features``; fitted with the model, so per training fold.

    Numbers: nulls become the median.  Texts: index by frequency, nulls and values not seen in
    training one further index.
    """
    text = [f.name for f in rows.schema.fields if f.name in features and isinstance(f.dataType, T.StringType)]
    numbers = [f for f in features if f not in text]
    stages = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"__n_{f}" for f in numbers], strategy="median"))
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"__i_{f}" for f in text], handleInvalid="keep"))
        # indices as plain numbers: trees would otherwise want a bin for every value
        plain = ", ".join(f"`__i_{f}` + 0.0D AS `__t_{f}`" for f in text)
        stages.append(SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"))
    inputs = [f"__t_{f}" if f in text else f"__n_{f}" for f in features]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def assemble(df: DataFrame, features: list[str], label: str, id_col: str, fold_col: str | None = None,
             index_label: bool = False) -> DataFrame:
    """id (and fold), numeric label and one ``features`` vector fitted on all rows (no folds: no leak to guard)."""
    rows = labelled(df, features, label, id_col, fold_col, index_label)
    keep = [c for c in rows.columns if c not in features]
    return Pipeline(stages=feature_stages(rows, features)).fit(rows).transform(rows).select(*keep, "features")


def concurrently(spark: SparkSession, work: Callable, items: Iterable, fits: int = FITS) -> list:
    """``work(item)`` of every item, in order, at most ``fits`` at a time, each in its own scheduler pool."""
    def one(numbered):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{numbered[0] % fits}")
        return work(numbered[1])

    with ThreadPoolExecutor(max_workers=max(1, fits)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), list(enumerate(items))))


def _synthetic(make: Callable) -> Callable:
    def grow(train: DataFrame, label: str, id_col: str) -> DataFrame:
        rows = train.select(id_col, label, vector_to_array("features").alias("x"))
        return make(rows, id_col, "x", label).select(
            F.col("id").alias(id_col), F.col("label").cast("double").alias(label), array_to_vector("x").alias("features"))

    return grow


BALANCERS = {"undersample_random": undersample_random, "oversample_random": oversample_random,
             "oversample_smote": _synthetic(oversample_smote), "oversample_adasyn": _synthetic(oversample_adasyn)}


@dataclass
class Fold:
    """Rows as vectors; the features were fitted on the training rows alone."""
    number: int
    train: DataFrame
    test: DataFrame

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def folded(rows: DataFrame, stages: list, fold_col: str, numbers: list | None = None, fits: int = FITS,
           spent: Iterable[str] = ()) -> list[Fold]:
    """The folds of ``rows``; feature ``stages`` are fitted once per fold and its vectors kept, without the columns ``spent``."""
    if numbers is None:
        numbers = sorted(r[0] for r in rows.select(fold_col).distinct().collect())
    raw = {c for stage in stages if stage.hasParam("inputCols") for c in stage.getInputCols()}
    keep = [c for c in rows.columns if c not in raw and c not in spent]

    def one(f) -> Fold:
        tr, te = rows.where(F.col(fold_col) != f), rows.where(F.col(fold_col) == f)
        if stages:
            model = Pipeline(stages=stages).fit(tr)
            tr, te = (model.transform(x).select(*keep, "features") for x in (tr, te))
        return Fold(f, tr.persist(), te.persist())

    return concurrently(rows.sparkSession, one, numbers, fits)


@dataclass
class CVResult:
    scored: DataFrame
    train_scores: dict = field(default_factory=dict)


def _probabilities(pred: DataFrame):
    """Probability of every class: the model's own, or from the margins of one-vs-rest."""
    if "probability" in pred.columns:
        return vector_to_array("probability")
    if "rawPrediction" in pred.columns:
        raw = vector_to_array("rawPrediction")
        odds = F.transform(raw, lambda m: 1 / (1 + F.exp(-2 * m)))
        return F.transform(odds, lambda p: p / F.greatest(F.aggregate(odds, F.lit(0.0), lambda a, x: a + x), F.lit(1e-300)))
    return F.lit(None).cast("array<double>")


def fit_fold(fold: Fold, estimator: Estimator, name: str, id_col: str, balance: str | None, classification: bool,
              positive: float) -> tuple[DataFrame, float | None]:
    """Held-out rows as scored by the fold's model, written; and the model's score on its training rows."""
    tr, est = fold.train, estimator
    if classification and balance == "class_weights":
        tr = class_weights(tr, "label", "weight")
        est = with_params(estimator, {"weightCol": "weight"})
    elif classification and balance in BALANCERS:
        tr = BALANCERS[balance](tr, "label", id_col).drop("copy")
    model = est.fit(tr)
    pred = model.transform(fold.test)
    prob = _probabilities(pred) if classification else F.lit(None).cast("array<double>")
    one = F.when(F.size(prob) > int(positive), prob[int(positive)]) if classification else F.lit(None)
    part = pred.select(F.col(id_col).alias("id"), "label", F.col("prediction").cast("double").alias("prediction"),
                       one.cast("double").alias("probability"), prob.alias("probabilities"),
                       F.lit(name).alias("model"), F.lit(fold.number).cast("long").alias("fold"))
    again = model.transform(fold.train)
    score = F.avg((F.col("prediction") == F.col("label")).cast("double")) if classification else _r2()
    return kept(part), again.select(score).first()[0]


def gathered(results: list) -> DataFrame:
    out = results[0][0]
    for part, _ in results[1:]:
        out = out.unionByName(part)
    return out


def cv_out_of_fold(matrix: DataFrame, estimator: Estimator, name: str, id_col: str, fold_col: str = "fold",
                   k: int | None = None, balance: str | None = None, classification: bool = True,
                   positive: float = 1.0, fits: int = FITS) -> CVResult:
    """Fit on k−1 folds, score the held-out fold, for every fold; union of held-out rows.

    ``estimator`` takes a ``features`` column, or is a pipeline whose last stage does and whose others make
    it.  ``balance`` (class_weights, undersample_random, oversample_random, oversample_smote,
    oversample_adasyn) acts inside the training folds only; the last two on the vectors.
    ``probabilities`` holds every class, ``probability`` the positive one.
    """
    _known(balance)
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    folds = folded(matrix, stages[:-1], fold_col, list(range(k)) if k is not None else None, fits)
    done = concurrently(matrix.sparkSession, lambda f: fit_fold(f, stages[-1], name, id_col, balance, classification, positive),
                        folds, fits)
    for f in folds:
        f.release()
    return CVResult(gathered(done), {f.number: score for f, (_, score) in zip(folds, done, strict=True)})


def _known(balance: str | None) -> None:
    if balance not in (None, "none", "class_weights", *BALANCERS):
        raise ValueError(f"unknown balancing {balance!r}")


def _r2():
    """R² as one aggregate; null when the label is constant."""
    sst = F.var_pop("label") * F.count("label")
    return F.when(sst > 0, 1 - F.sum((F.col("label") - F.col("prediction")) ** 2) / sst)


def class_scores(scored: DataFrame) -> DataFrame:
    """Long (id, model, fold, label, class, score), one row per class: the input of the one-vs-rest AUC."""
    return scored.select("id", "model", "fold", "label", F.posexplode("probabilities").alias("class", "score")) \
        .withColumn("class", F.col("class").cast("double"))


def leaderboard(scored: DataFrame, train_scores: dict[str, float], classification: bool = True, n_classes: int = 2) -> DataFrame:
    """Per model: cv score (mean accuracy or max(R², 0) over folds), fold std, F1, AUC, train score.

    Spark has one boosted learner, so boosted trees are one candidate.
    """
    spark = scored.sparkSession
    if classification:
        acc = eval_accuracy(scored, ["model", "fold"]).groupBy("model").agg(
            F.avg("accuracy").alias("cv_score"), F.stddev_pop("accuracy").alias("cv_std"))
        f1 = eval_macro_weighted(scored, ["model"]).select("model", F.col("weighted_f1").alias("f1"))
        auc = (eval_auc_roc(scored, ["model"]).select("model", F.col("auc").alias("auc_roc")) if n_classes <= 2 else
               eval_auc_ovr(class_scores(scored), ["model"]).select("model", F.col("auc_weighted").alias("auc_roc")).distinct())
        lb = acc.join(f1, "model").join(auc, "model", "left")
    else:
        r = eval_r2_rmse_mae(scored, ["model", "fold"]).groupBy("model").agg(
            F.greatest(F.avg("r2"), F.lit(0.0)).alias("cv_score"), F.stddev_pop("r2").alias("cv_std"),
            F.avg("rmse").alias("rmse"))
        lb = r
    ts = spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in train_scores.items()],
                               "model string, train_score double")
    return lb.join(ts, "model", "left").withColumnRenamed("model", "model_name")


def _rows_and_candidates(df, features, label, id_col, fold_col, classification):
    """Kept raw rows in partitions of a useful size, the feature stages, the candidates and the number of classes."""
    rows = labelled(df, features, label, id_col, fold_col, index_label=classification).persist()
    n = rows.count()
    parts = max(1, -(-n // ROWS_A_TASK))
    if rows.rdd.getNumPartitions() > parts:
        rows = rows.coalesce(parts)
    elif rows.rdd.getNumPartitions() < -(-n // MOST_ROWS_A_TASK):
        few_parts, rows = rows, rows.repartition(-(-n // MOST_ROWS_A_TASK)).persist()
        rows.count()
        few_parts.unpersist()
    classes = rows.select("label").distinct().count() if classification else 0
    return rows, feature_stages(rows, features), classifiers(classes) if classification else regressors(n), classes


def train_candidates(df: DataFrame, features: list[str], label: str, id_col: str, fold_col: str,
                     classification: bool = True, balance: str | None = None, models: list[str] | None = None,
                     params: dict | None = None, fits: int = FITS) -> tuple[DataFrame, DataFrame]:
    """All candidates with k-fold CV: (leaderboard, scored rows).

    Features may be numbers or texts with nulls; imputation and encoding are fitted once per training
    fold and shared by the candidates.  ``params`` overrides parameters by model name.
    """
    _known(balance)
    rows, stages, cands, classes = _rows_and_candidates(df, features, label, id_col, fold_col, classification)
    folds = folded(rows, stages, fold_col, fits=fits)
    # the slowest candidate first, so that its folds do not run alone at the end
    work = [(name, fold) for name in cands if not models or name in models for fold in folds]
    done = concurrently(rows.sparkSession, lambda w: fit_fold(
        w[1], with_params(cands[w[0]], (params or {}).get(w[0], {})), w[0], id_col, balance, classification, 1.0), work, fits)
    train: dict[str, list] = {}
    for (name, _), (_, score) in zip(work, done, strict=True):
        train.setdefault(name, []).extend([] if score is None else [score])
    for f in folds:
        f.release()
    rows.unpersist()
    scored = gathered(done)
    return leaderboard(scored, {n: sum(v) / len(v) if v else None for n, v in train.items()}, classification, classes), scored


def kept(scored: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: models are not run again for every reader."""
    from ...session import ensure_checkpoint_dir
    ensure_checkpoint_dir(scored.sparkSession)
    return scored.checkpoint()


def feature_importance(model, features: list[str]) -> list[tuple[str, float]]:
    """Native importances or |coefficients| of all features, normalised to sum 1 (model metadata)."""
    if hasattr(model, "featureImportances"):
        imps = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficients"):
        imps = [abs(x) for x in model.coefficients.toArray()]
    elif hasattr(model, "coefficientMatrix"):
        arr = model.coefficientMatrix.toArray()
        imps = [abs(float(x)) for x in arr[0]]
    else:
        return []
    tot = sum(imps)
    if tot == 0:
        return []
    return sorted(((f, float(v) / float(tot)) for f, v in zip(features, imps)), key=lambda x: (-x[1], x[0]))


def retrain_one(df: DataFrame, features: list[str], label: str, id_col: str, fold_col: str, model_name: str,
                params: dict, leaderboard_df: DataFrame | None = None, classification: bool = True):
    """One candidate with given parameters; patches the leaderboard (anti-join old row, union new)."""
    lb, scored = train_candidates(df, features, label, id_col, fold_col, classification, models=[model_name],
                                  params={model_name: params})
    if leaderboard_df is not None:
        lb = leaderboard_df.join(lb.select("model_name"), "model_name", "left_anti").unionByName(lb)
    return lb, scored


def draw(space: dict, rng: random.Random) -> dict:
    """One trial: a value of every parameter."""
    out = {}
    for name, (least, most, scale) in sorted(space.items()):
        if scale == "int":
            out[name] = rng.randint(least, most)
        elif scale == "log":
            out[name] = math.exp(rng.uniform(math.log(least), math.log(most)))
        else:
            out[name] = rng.uniform(least, most)
    return out


def tune_random_search(df: DataFrame, features: list[str], label: str, id_col: str, fold_col: str,
                       model_name: str, n_trials: int = 30, seed: int = SEED, classification: bool = True,
                       fits: int = FITS) -> DataFrame:
    """Random search over ``SEARCH_SPACE``, every trial scored on the given folds (accuracy or R²).

    Returns one row per trial asked for (params as text, mean CV metric), best first;
    ``retrain_best`` trains with the first row's parameters.
    """
    if n_trials < 1:
        raise ValueError("at least one trial is needed")
    rows, stages, cands, _ = _rows_and_candidates(df, features, label, id_col, fold_col, classification)
    rng = random.Random(seed)
    trials = [draw(SEARCH_SPACE[model_name], rng) for _ in range(n_trials)]
    folds = folded(rows, stages, fold_col, fits=fits)
    score = F.avg((F.col("prediction") == F.col("label")).cast("double")) if classification else _r2()

    def one(work) -> float | None:
        trial, fold = work
        return with_params(cands[model_name], trial).fit(fold.train).transform(fold.test).select(score).first()[0]

    found = concurrently(rows.sparkSession, one, [(t, f) for t in trials for f in folds], fits)
    for f in folds:
        f.release()
    rows.unpersist()
    out = []
    for i, t in enumerate(trials):
        scores = [v for v in found[i * len(folds):(i + 1) * len(folds)] if v is not None]
        out.append((json.dumps(t, sort_keys=True), sum(scores) / len(scores) if scores else None))
    return df.sparkSession.createDataFrame(out, "params string, cv_score double").orderBy(F.desc_nulls_last("cv_score"), F.asc("params"))


def retrain_best(df: DataFrame, features: list[str], label: str, id_col: str, fold_col: str, model_name: str,
                 trials: DataFrame, leaderboard_df: DataFrame | None = None, classification: bool = True):
    """``retrain_one`` with the parameters of the best trial."""
    best = trials.orderBy(F.desc("cv_score"), F.asc("params")).first()
    return retrain_one(df, features, label, id_col, fold_col, model_name, json.loads(best.params), leaderboard_df, classification)


def learning_curve(df: DataFrame, features: list[str], label: str, id_col: str, model_name: str = "logistic_regression",
                   fractions=(0.2, 0.4, 0.6, 0.8, 1.0), holdout: float = 0.2, seed: int = SEED,
                   classification: bool = True) -> DataFrame:
    """Train on nested hash-prefix samples of a fixed training pool; score on a fixed hold-out.

    Samples are drawn inside the pool only (quirk Q14: no hold-out leakage).
    """
    rows, stages, cands, _ = _rows_and_candidates(df, features, label, id_col, None, classification)
    u = hash_share(id_col, seed)
    test, pipe = rows.where(u < holdout), Pipeline(stages=[*stages, cands[model_name]])
    score = F.avg((F.col("prediction") == F.col("label")).cast("double")) if classification else _r2()

    def one(fr: float) -> tuple:
        tr = rows.where((u >= holdout) & (u < holdout + (1 - holdout) * fr))
        model = pipe.fit(tr)
        trs, size = model.transform(tr).select(score, F.count(F.lit(1))).first()
        vs = model.transform(test).select(score).first()[0]
        return float(fr), size, trs, vs, (trs - vs) if trs is not None and vs is not None else None

    out = concurrently(rows.sparkSession, one, fractions)
    rows.unpersist()
    return df.sparkSession.createDataFrame(
        out, "training_fraction double, training_size long, train_score double, val_score double, gap double")


# Bands of the verdicts and their notes.
STD_STABLE, STD_UNSTABLE = 0.02, 0.05
GAP_MILD, GAP_STRONG, GAP_FOREST = 0.05, 0.15, 0.10
AUC_GOOD, AUC_MODERATE, AUC_WEAK = 0.75, 0.65, 0.6
F1_STRONG, F1_LOW = 0.75, 0.6
FAMILY_STRENGTHS = {
    "logistic_regression": ["Fully interpretable (linear coefficients)", "Very fast inference — linear complexity"],
    "random_forest": ["Robust to outliers and noisy features", "Feature importances available natively"],
    "gbt": ["Fast inference, scalable to large datasets", "Handles missing values natively",
            "Usually best tabular performance (Kaggle benchmark)"],
}
NOTE_NON_LINEAR = "Cannot capture non-linear relationships"
NOTE_MEMORISES = "Tends to memorise training data — consider lower max_depth"


def model_verdicts(lb: DataFrame, classification: bool = True) -> DataFrame:
    """Strength / weakness notes from fold spread, over-fitting gap, AUC, F1 and model family.

    A missing AUC or F1 gives no note; so does a band between two limits.
    """
    std, gap = F.coalesce(F.col("cv_std"), F.lit(0.0)), F.coalesce(F.col("train_score"), F.lit(0.0)) - F.coalesce(F.col("cv_score"), F.lit(0.0))
    name = F.col("model_name")
    auc, f1 = (F.col(c) if classification and c in lb.columns else F.lit(None).cast("double") for c in ("auc_roc", "f1"))
    text = F.format_string
    strengths = [
        F.when(std < STD_STABLE, text("Very stable across folds (σ=%.1f%%)", std * 100)),
        F.when(gap <= GAP_MILD, F.lit("No significant overfitting detected")),
        F.when(auc > AUC_GOOD, text("Good discrimination (AUC=%.3f)", auc)).when(auc > AUC_MODERATE, text("Moderate discrimination (AUC=%.3f)", auc)),
        F.when(f1 > F1_STRONG, F.lit("Strong weighted F1")),
        *[F.when(name == family, F.lit(note)) for family, notes in FAMILY_STRENGTHS.items() for note in notes]]
    weaknesses = [
        F.when(std > STD_UNSTABLE, text("Unstable fold scores (σ=%.1f%%) — check for data issues", std * 100)),
        F.when(gap > GAP_STRONG, text("Strong overfitting — train-CV gap %.1f%%", gap * 100))
        .when(gap > GAP_MILD, text("Mild overfitting — train-CV gap %.1f%%", gap * 100)),
        F.when(auc < AUC_WEAK, text("Weak discrimination (AUC=%.3f) — model may not rank risk well", auc)),
        F.when(f1 < F1_LOW, F.lit("Low F1 — likely struggling with minority class")),
        F.when(name == "logistic_regression", F.lit(NOTE_NON_LINEAR)),
        F.when((name == "random_forest") & (gap > GAP_FOREST), F.lit(NOTE_MEMORISES))]
    notes = lambda items: F.concat_ws("; ", F.filter(F.array(*items), lambda x: x.isNotNull()))
    return lb.select("model_name", "cv_score", "cv_std", "train_score", auc.alias("auc_roc"), f1.alias("f1"),
                     notes(strengths).alias("strengths"), notes(weaknesses).alias("weaknesses"))
