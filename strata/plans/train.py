"""Training, tuning, cross-validation, scoring and importance.

The preprocessing pipeline is fitted on the training split only; models are
Spark ML learners from the registry.  Scores are DataFrame aggregations.
"""

from __future__ import annotations

import itertools
import logging
import random
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import evaluate as EV
from strata.operators import models as M
from strata.operators import split as SP
from strata.plans.preprocess import PreprocessConfig, build_preprocessor

log = logging.getLogger(__name__)


@dataclass
class TrainConfig:
    test_size: float = 0.20
    random_state: int = 42
    shuffle: bool = True
    cross_validation: bool = True
    cv_folds: int = 5
    stratified: bool = True
    hyperparameter_tuning: bool = False
    tuning_method: str = "grid"
    tuning_iterations: int = 25
    exact_split: bool = False
    # accuracy, f1, precision, recall (classification); r2, neg_mean_squared_error,
    # neg_mean_absolute_error, neg_root_mean_squared_error (regression); None: accuracy or r2
    scoring: str | None = None


@dataclass
class TrainingResult:
    model: object
    prep: object
    labels: M.LabelIndex | None
    features: list
    target: str
    problem: str
    training_time: float
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    cross_validation: DataFrame | None = None
    best_parameters: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    id_col: object = None


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------

class FeaturePrep:
    """Assembles the ``features`` vector: an array column is converted in
    place; otherwise the preprocessing pipeline (fitted on training rows)."""

    def __init__(self, features: list, target: str, config: PreprocessConfig | None = None):
        self.features, self.target, self.config = features, target, config
        self.model = None

    def _single_array(self, df):
        return (len(self.features) == 1 and
                isinstance(df.schema[self.features[0]].dataType, T.ArrayType))

    def fit(self, train: DataFrame) -> "FeaturePrep":
        if not self._single_array(train):
            pipe, _, _ = build_preprocessor(train.select(*self.features, self.target), self.config, self.target)
            self.model = pipe.fit(train)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("features", array_to_vector(F.col(self.features[0]).cast("array<double>")))
        return self.model.transform(df)

    def output_names(self, df: DataFrame) -> list[str]:
        if self.model is None:
            n = len(df.select(self.features[0]).first()[0])
            return [f"{self.features[0]}_{i}" for i in range(n)]
        from strata.plans.preprocess import transformed_feature_names
        return transformed_feature_names(self.model, df)


def _with_label(df: DataFrame, target: str, labels: M.LabelIndex | None) -> DataFrame:
    lab = labels.to_index(F.col(target)) if labels else F.col(target).cast("double")
    return df.withColumn("label", lab)


# Scoring names and the metric (and sign) they stand for.
SCORINGS = {"accuracy": ("accuracy", 1), "f1": ("f1", 1), "precision": ("precision", 1), "recall": ("recall", 1),
            "r2": ("R2", 1), "neg_mean_squared_error": ("MSE", -1), "neg_mean_absolute_error": ("MAE", -1),
            "neg_root_mean_squared_error": ("RMSE", -1)}


def score_expr_df(pred: DataFrame, problem: str, scoring: str | None = None) -> DataFrame:
    """One row (score): accuracy for classification, R² for regression, or the named scoring."""
    scoring = scoring or ("accuracy" if problem == "classification" else "r2")
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}")
    if scoring == "accuracy":
        return pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("score"))
    metric, sign = SCORINGS[scoring]
    of = EV.classification_metrics if problem == "classification" else EV.regression_metrics
    return of(pred, "label", "prediction").select((F.col(metric) * sign).alias("score"))


# ---------------------------------------------------------------------------
# training
# ---------------------------------------------------------------------------

def split(df: DataFrame, target: str, id_col, problem: str, config: TrainConfig) -> DataFrame:
    if config.exact_split and problem == "classification" and config.stratified:
        return SP.stratified_split(df, target, id_col, config.test_size, config.random_state)
    return SP.hash_split(df, id_col, config.test_size, config.random_state)


def fit_once(train: DataFrame, features, target, learner, problem, labels, prep_config=None):
    prep = FeaturePrep(features, target, prep_config).fit(train)
    data = _with_label(prep.transform(train), target, labels).where(F.col("label").isNotNull())
    fitted = learner.fit(data, "features", "label")
    return prep, fitted


def fold_rows(df: DataFrame, target, problem, id_col, config: TrainConfig) -> DataFrame:
    """``df`` with its fold number: stratified exact folds for classification, hash folds otherwise."""
    if problem == "classification" and config.stratified:
        return SP.stratified_split(df, target, id_col, config.test_size, config.random_state,
                                   flag="__t", k_folds=config.cv_folds).drop("__t")
    return df.withColumn("fold", SP.hash_fold(id_col, config.cv_folds, config.random_state))


#: rows that a task of a fold's jobs takes, at least
FOLD_ROWS = 200_000


def kept_folds(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is persisted, the same rows in few partitions).

    Every fold is fitted and scored in dozens of jobs, and what a task tells the driver is as
    large for few rows as for many; so the partitions grow with the rows, not with the shuffle's."""
    kept = folded.persist()
    tasks = max(folded.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // FOLD_ROWS))
    return kept, kept.coalesce(tasks)


def cross_validate(df: DataFrame, features, target, learner_factory, problem, id_col,
                   config: TrainConfig, labels=None, folded: DataFrame | None = None) -> DataFrame:
    """(fold, train_score, test_score, fit_time) for k folds; ``folded`` passes rows folded before."""
    own = folded is None
    if own:
        kept, folded = kept_folds(fold_rows(df, target, problem, id_col, config))
    rows = []
    for k in range(config.cv_folds):
        tr, te = folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)
        t0 = time.perf_counter()
        prep, fitted = fit_once(tr, features, target, learner_factory(), problem, labels)
        fit_time = time.perf_counter() - t0
        both = [score_expr_df(fitted.transform(_with_label(prep.transform(part), target, labels)), problem,
                              config.scoring).first()[0] for part in (tr, te)]
        rows.append((k, *(float(x) if x is not None else None for x in both), fit_time))
    if own:
        kept.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, train_score double, test_score double, fit_time double")


def cross_validation_summary(cv: DataFrame) -> DataFrame:
    """(Metric, Mean, Std) with the population deviation, per score column."""
    parts = [cv.agg(F.lit(c).alias("Metric"), F.avg(c).alias("Mean"), F.stddev_pop(c).alias("Std"))
             for c in ("train_score", "test_score", "fit_time")]
    return reduce(DataFrame.unionByName, parts)


def parameter_candidates(grid: dict, method: str = "grid", iterations: int = 25, seed: int = 42) -> list[dict]:
    keys = sorted(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if method == "random" and len(combos) > iterations:
        rnd = random.Random(seed)
        combos = rnd.sample(combos, iterations)
    return combos


def tune(df, features, target, model_name, problem, id_col, grid, config: TrainConfig, labels=None, overrides=None):
    """Grid (or seeded random) search over parameters on top of ``overrides``: the best mean CV
    test score wins; an empty grid is a plain fit with defaults.  Rows are folded once for all."""
    if not grid:
        return {}, None
    best, best_score, table = {}, None, []
    kept, folded = kept_folds(fold_rows(df, target, problem, id_col, config))
    for params in parameter_candidates(grid, config.tuning_method, config.tuning_iterations,
                                       config.random_state):
        cv = cross_validate(df, features, target,
                            lambda p=params: M.create_model(model_name, problem, **{**(overrides or {}), **p}),
                            problem, id_col, config, labels, folded)
        s = cv.agg(F.avg("test_score")).first()[0]
        table.append((str(params), float(s) if s is not None else None))
        if s is not None and (best_score is None or s > best_score):
            best, best_score = params, s
    kept.unpersist()
    res = df.sparkSession.createDataFrame(table, "params string, mean_test_score double")
    return best, res


def train_model(df: DataFrame, target: str, model_name: str, problem: str, features=None,
                id_col=None, config: TrainConfig | None = None, grid: dict | None = None,
                overrides: dict | None = None) -> TrainingResult:
    """split → (tune) → fit → predict the test rows → (cross-validate on all rows)."""
    config = config or TrainConfig()
    overrides = overrides or {}
    features = features or [c for c in df.columns if c != target and c != id_col]
    id_col = id_col or features
    labels = M.LabelIndex.fit(df, target) if problem == "classification" else None
    flagged = split(df, target, id_col, problem, config)
    train = flagged.where(~F.col("is_test")).drop("is_test")
    test = flagged.where(F.col("is_test")).drop("is_test")
    best = {}
    if config.hyperparameter_tuning and grid:
        best, _ = tune(train, features, target, model_name, problem, id_col, grid, config, labels, overrides)
    params = dict(overrides)
    params.update(best)
    t0 = time.perf_counter()
    prep, fitted = fit_once(train, features, target, M.create_model(model_name, problem, **params), problem, labels)
    training_time = time.perf_counter() - t0
    preds = fitted.transform(_with_label(prep.transform(test), target, labels))
    cv = None
    if config.cross_validation:
        cv = cross_validate(df, features, target, lambda: M.create_model(model_name, problem, **params),
                            problem, id_col, config, labels)
    meta = {"problem_type": problem, "features": features, "target": target, "model": model_name}
    return TrainingResult(fitted, prep, labels, features, target, problem, training_time, train, test, preds,
                          cv, best, meta, id_col)


# Training-summary metric names.
SUMMARY_METRICS = ("Training Time (seconds)", "Training Samples", "Testing Samples", "Number of Features",
                   "Hyperparameter Tuning")


def training_summary(result: TrainingResult) -> DataFrame:
    """(Metric, Value) rows; the sample counts are Spark counts of the splits."""
    spark = result.train.sparkSession
    counts = result.train.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(SUMMARY_METRICS[1]).alias("Metric"), F.col("n").cast("string").alias("Value")).unionByName(
        result.test.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(SUMMARY_METRICS[2]).alias("Metric"), F.col("n").cast("string").alias("Value")))
    static = spark.createDataFrame(
        [(SUMMARY_METRICS[0], str(round(result.training_time, 4))),
         (SUMMARY_METRICS[3], str(len(result.features))),
         (SUMMARY_METRICS[4], "Enabled" if result.best_parameters else "Disabled")], "Metric string, Value string")
    return static.unionByName(counts)


# ---------------------------------------------------------------------------
# scoring new data
# ---------------------------------------------------------------------------

def predict(result: TrainingResult, df: DataFrame, fill=0) -> DataFrame:
    """Original columns + ``Prediction`` (+ ``Probability_Class_<i>``).  Missing
    training features are added as ``fill``, extras are ignored by the model."""
    types = {f.name: f.dataType for f in result.train.schema.fields}
    missing = [c for c in result.features if c not in df.columns]
    base = df.select("*", *[(F.lit(fill).cast(types[c]) if fill is not None else F.lit(None).cast(types[c]))
                            .alias(c) for c in missing])
    scored = result.model.transform(result.prep.transform(base))
    pred = result.labels.to_label(F.col("prediction")) if result.labels else F.col("prediction")
    out = [F.col(f"`{c}`") for c in df.columns] + [pred.alias("Prediction")]
    if result.labels and "probability" in scored.columns:
        arr = vector_to_array("probability")
        out += [arr[i].alias(f"Probability_Class_{i}") for i in range(len(result.labels.labels))]
    keep = scored.drop(*missing) if missing else scored
    return keep.select(*out)


def prediction_summary(pred: DataFrame) -> DataFrame:
    """One row: rows predicted, whether probabilities exist, output columns."""
    has_p = any(c.startswith("Probability_Class_") for c in pred.columns)
    return pred.agg(F.count(F.lit(1)).alias("rows_predicted")).select(
        "rows_predicted", F.lit(has_p).alias("probabilities"),
        F.lit(len(pred.columns)).cast("long").alias("output_columns"))


# ---------------------------------------------------------------------------
# importance
# ---------------------------------------------------------------------------

def feature_importance(result: TrainingResult) -> DataFrame | None:
    """(feature, importance) sorted descending: tree importances or |coef|
    (mean over classes); None for models without either."""
    imps = result.model.feature_importances
    if imps is None:
        return None
    names = result.prep.output_names(result.train)
    if len(names) != len(imps):
        names = [f"feature_{i}" for i in range(len(imps))]
    spark = result.train.sparkSession
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imps)], "feature string, importance double") \
        .orderBy(F.desc("importance"), F.asc("feature"))


def permutation_importance(result: TrainingResult, data: DataFrame, id_col, repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): drop of the default score when one input
    column's values are permuted across rows.

    Rows are numbered once by their ids.  In repeat r the row numbered d lends its values to
    the row at d's place in the permutation keyed by ``seed + r`` (``keyed_permutation``: no
    sort, no table), so one join serves all repeats.  Each pair then becomes a row per
    feature, with that feature's value lent, and one job scores all of them with the model
    and adds the scores up by repeat and feature.
    """
    from strata.functions.permute import permuted_places
    from strata.operators.ordered import running_sums
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    columns = [*result.features, result.target]
    keyed = data.select(F.concat_ws(":", *[F.col(c).cast("string") for c in ids]).alias("__o"),
                        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)])
    rows = running_sums(keyed, ["__o"], [], rank_col="__n").withColumn("__at", F.col("__n") - 1).drop("__o", "__n")
    n = rows.count()
    lent = [f"__l{i}" for i in range(len(result.features))]
    lenders = rows.select(
        F.posexplode(permuted_places(F.col("__at"), n, [seed + r for r in range(repeats)])).alias("__repeat", "__at"),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(lent)])
    pairs = rows.join(lenders, "__at").withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(len(lent) - 1))))
    as_is = rows.select("__at", *[f"__c{i}" for i in range(len(columns))], F.lit(-1).alias("__repeat"),
                        F.lit(-1).alias("__turn"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(lent)])
    every = pairs.select(*as_is.columns).unionByName(as_is)
    table = every.select("__repeat", "__turn", *[
        F.when(F.col("__turn") == i, F.col(lent[i])).otherwise(F.col(f"__c{i}")).alias(c) if i < len(lent)
        else F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])
    scored = result.model.transform(_with_label(result.prep.transform(table), result.target, result.labels))
    if result.problem == "classification":
        score = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    else:
        error = F.sum((F.col("label") - F.col("prediction")) ** 2)
        spread = F.var_pop("label") * F.count("label")
        score = F.when(spread > 0, 1 - error / spread).when(error == 0, 1.0).otherwise(0.0)
    found = scored.groupBy("__repeat", "__turn").agg(score.cast("double").alias("score")).collect()  # repeats x features
    base = next((r["score"] for r in found if r["__turn"] < 0), None)
    drops = data.sparkSession.createDataFrame(
        [(result.features[r["__turn"]], None if None in (base, r["score"]) else base - r["score"])
         for r in found if r["__turn"] >= 0], "feature string, drop double")
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                        F.stddev_pop("drop").alias("importance_std")) \
        .orderBy(F.desc("importance_mean"), F.asc("feature"))


def _scores_of(p: DataFrame, labels: M.LabelIndex) -> DataFrame:
    """One row (roc_auc) from the class probabilities."""
    k = len(labels.labels)
    arr = p.withColumn("__p", vector_to_array("probability"))
    if k == 2:
        return EV.roc_auc(arr.withColumn("__s", F.col("__p")[1]), "label", "__s", 1.0)
    wide = arr.select(F.col("label").cast("string").alias("label"), *[F.col("__p")[i].alias(f"__p{i}") for i in range(k)])
    return EV.roc_auc_ovr(wide, "label", {str(float(i)): f"__p{i}" for i in range(k)})


def evaluate_model(result: TrainingResult, permutation: bool = True, id_col=None, repeats: int = 10) -> dict:
    """Metrics (with ROC AUC in the row where there are probabilities), confusion matrix and report in
    the user's labels, feature importance and permutation importance (by the training ids unless
    ``id_col`` is given).  A part that cannot be computed is None; ``problems`` names it and why."""
    out, problems = {}, {}
    p = result.predictions

    def part(name, make):
        try:
            out[name] = make()
        except Exception as e:  # noqa: BLE001  the other parts are still of use
            log.warning("evaluation part %s failed: %s", name, e)
            out[name], problems[name] = None, f"{type(e).__name__}: {e}"

    if result.problem == "classification":
        named = p.withColumn("actual", result.labels.to_label(F.col("label"))).withColumn(
            "predicted", result.labels.to_label(F.col("prediction")))
        metrics = EV.classification_metrics(named, "actual", "predicted")
        out["confusion_matrix"] = EV.confusion_matrix(named, "actual", "predicted")
        out["classification_report"] = EV.classification_report(named, "actual", "predicted")
        out["roc_auc"] = None
        if "probability" in p.columns:
            part("roc_auc", lambda: _scores_of(p, result.labels))
        if out["roc_auc"] is not None:
            from strata.operators.health import _side_by_side
            metrics = _side_by_side(metrics, out["roc_auc"])
        out["metrics"] = metrics
    else:
        out["metrics"] = EV.regression_metrics(p, "label", "prediction")
    part("feature_importance", lambda: feature_importance(result))
    if permutation:
        part("permutation_importance",
             lambda: permutation_importance(result, result.test, id_col or result.id_col, repeats))
    out["problems"] = problems
    return out


# ---------------------------------------------------------------------------
# saving and loading
# ---------------------------------------------------------------------------

def save_result(result: TrainingResult, path: str) -> str:
    """Model, fitted preparation, labels and metadata under ``path`` (any file system Spark writes)."""
    spark = result.train.sparkSession
    M.save_fitted(spark, result.model, f"{path}/model")
    if result.prep.model is not None:
        result.prep.model.write().overwrite().save(f"{path}/prep")
    empty = result.train.limit(0)
    empty.write.mode("overwrite").parquet(f"{path}/schema")
    label_type = None if result.labels is None else empty.schema[result.target].dataType.simpleString()
    doc = {"features": result.features, "target": result.target, "problem": result.problem,
           "has_prep": result.prep.model is not None, "label_type": label_type,
           "labels": None if result.labels is None else [str(x) for x in result.labels.labels],
           "training_time": result.training_time, "best_parameters": result.best_parameters,
           "metadata": result.metadata, "id_col": result.id_col}
    M.write_json(spark, doc, f"{path}/result")
    return path


def load_result(spark, path: str) -> TrainingResult:
    """A saved result, ready for ``predict`` (its predictions and cross-validation are not saved)."""
    from pyspark.ml import PipelineModel
    doc = M.read_json(spark, f"{path}/result")
    prep = FeaturePrep(doc["features"], doc["target"])
    if doc["has_prep"]:
        prep.model = PipelineModel.load(f"{path}/prep")
    labels = None
    if doc["labels"] is not None:
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(doc["labels"])], "i int, v string")
        labels = M.LabelIndex([r[1] for r in sorted(rows.select("i", F.col("v").cast(doc["label_type"])).collect())])
    train = spark.read.parquet(f"{path}/schema")
    return TrainingResult(M.load_fitted(spark, f"{path}/model"), prep, labels, doc["features"], doc["target"],
                          doc["problem"], doc["training_time"], train, train, None, None, doc["best_parameters"],
                          doc["metadata"], doc["id_col"])
