"""Model registry and learners on Spark ML.

Every learner has ``fit(df, features_col, label_col) -> fitted`` and the fitted
object ``transform(df)`` adds ``prediction`` (and ``probability`` for
classifiers that have one).  Labels of a classification problem are indexed
0..k−1 in sorted order before fitting (``LabelIndex``).  Parameters follow the
reference's scikit-learn defaults, mapped to Spark ML's parameterisation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir

MAX_TREE_DEPTH = 30  # Spark ML's limit; scikit-learn trees are unbounded by default
OVR_PARALLELISM = 8  # one-vs-rest binary models fitted concurrently


# ---------------------------------------------------------------------------
# label indexing
# ---------------------------------------------------------------------------

@dataclass
class LabelIndex:
    labels: list

    @staticmethod
    def fit(df: DataFrame, label: str) -> "LabelIndex":
        """Sorted class labels (a classifier has one output per class, so their list is a part of the model)."""
        return LabelIndex(sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect()))

    def to_index(self, c):
        m = F.create_map(*[v for i, lab in enumerate(self.labels) for v in (F.lit(lab), F.lit(float(i)))])
        return m[c]

    def to_label(self, c):
        m = F.create_map(*[v for i, lab in enumerate(self.labels) for v in (F.lit(float(i)), F.lit(lab))])
        return m[c]


# ---------------------------------------------------------------------------
# learners
# ---------------------------------------------------------------------------

class SparkLearner:
    """A Spark ML estimator with parameters that may depend on the training
    data (row count, label deviation), resolved at fit time."""

    def __init__(self, make: Callable[[DataFrame, str, str], Any], probability: bool):
        self.make = make
        self.probability = probability

    def fit(self, df: DataFrame, features_col: str = "features", label_col: str = "label"):
        est = self.make(df, features_col, label_col)
        return SparkFitted(est.fit(df))


class SparkFitted:
    def __init__(self, model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    @property
    def feature_importances(self):
        m = self.model
        if hasattr(m, "featureImportances"):
            return list(m.featureImportances.toArray())
        if hasattr(m, "coefficientMatrix"):
            mat = m.coefficientMatrix.toArray()
            return list(abs(mat).mean(axis=0))
        if hasattr(m, "coefficients"):
            return [abs(x) for x in m.coefficients.toArray()]
        return None


def _count(df):
    return df.count()


def _label_sd(df, label):
    return df.agg(F.stddev_samp(label)).first()[0] or 1.0


def logistic(C_: float = 1.0, max_iter: int = 1000, **kw):
    """L2 logistic regression as scikit-learn: regParam = 1/(C·n), no standardisation."""
    def make(df, fc, lc):
        n = _count(df)
        return C.LogisticRegression(featuresCol=fc, labelCol=lc, regParam=1.0 / (C_ * max(n, 1)),
                                    elasticNetParam=0.0, standardization=False, maxIter=max_iter, **kw)
    return SparkLearner(make, True)


def tree_classifier(max_depth: int = MAX_TREE_DEPTH, seed: int = 42, **kw):
    return SparkLearner(lambda df, fc, lc: C.DecisionTreeClassifier(
        featuresCol=fc, labelCol=lc, maxDepth=min(max_depth, MAX_TREE_DEPTH), seed=seed, **kw), True)


def tree_regressor(max_depth: int = MAX_TREE_DEPTH, seed: int = 42, **kw):
    return SparkLearner(lambda df, fc, lc: R.DecisionTreeRegressor(
        featuresCol=fc, labelCol=lc, maxDepth=min(max_depth, MAX_TREE_DEPTH), seed=seed, **kw), False)


#: trees that one Spark forest grows, and forests that grow at the same time
FOREST_GROUP, FOREST_THREADS = 30, 5


class ForestLearner:
    """A random forest grown as groups of trees, each a Spark ML forest over all rows.

    A pass of Spark over the data serves as many nodes as its memory holds, and the driver
    books every node of a level, so hundreds of deep trees in one forest wait for each other;
    groups have the nodes of a few trees each, and several grow side by side.  Group i draws
    its bootstrap samples with seed ``seed + i``; the trees are those of one forest otherwise.
    """

    def __init__(self, estimator, probability: bool, num_trees: int, max_depth: int, seed: int, strategy: str,
                 group: int = FOREST_GROUP, threads: int = FOREST_THREADS, **kw):
        self.estimator, self.probability, self.num_trees, self.seed = estimator, probability, num_trees, seed
        self.group, self.threads = group, threads
        # many rows of few features: regression trees that see all features grow on the cells of a grid
        self.on_grid = not probability and strategy == "all" and not kw
        # many rows: classification trees grow where the rows of a node meet, not in a pass over all rows
        self.in_pieces = probability and strategy == "sqrt" and not kw
        # where a row stands in each tree is kept (and checkpointed), not found again from the root in every pass
        self.kw = dict(maxDepth=min(max_depth, MAX_TREE_DEPTH), featureSubsetStrategy=strategy, cacheNodeIds=True) | kw

    def fit(self, df: DataFrame, features_col: str = "features", label_col: str = "label"):
        from concurrent.futures import ThreadPoolExecutor

        from pyspark import StorageLevel, inheritable_thread_target
        if self.on_grid:
            from strata.operators import grid as G
            grid = G.make_grid(df, features_col, self.seed)
            if grid is not None:
                return G.fit_forest(df, grid, features_col, label_col, self.num_trees, self.kw["maxDepth"], self.seed)
        ensure_checkpoint_dir(df.sparkSession)
        if self.in_pieces:
            from strata.operators import forest as P
            made = P.fit_forest(df, features_col, label_col, self.num_trees, self.kw["maxDepth"], self.seed)
            if made is not None:
                return made
        rows = df.select(features_col, label_col).persist(StorageLevel.MEMORY_AND_DISK)
        sizes = [min(self.group, self.num_trees - at) for at in range(0, self.num_trees, self.group)]

        @inheritable_thread_target(df.sparkSession)
        def grow(i):
            return self.estimator(featuresCol=features_col, labelCol=label_col, numTrees=sizes[i], seed=self.seed + i,
                                  **self.kw).fit(rows)
        try:
            with ThreadPoolExecutor(min(self.threads, len(sizes))) as pool:
                return ForestFitted(list(pool.map(grow, range(len(sizes)))))
        finally:
            rows.unpersist()


class ForestFitted:
    """Forests that vote as one: class votes are added, predicted numbers averaged by trees."""

    def __init__(self, models):
        self.models = models

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        out, parts = df, [f"__f{i}" for i in range(len(self.models))]
        if not hasattr(self.models[0], "numClasses"):
            for m, part in zip(self.models, parts):
                out = m.copy({m.predictionCol: part}).transform(out)
            trees = [m.getNumTrees for m in self.models]
            total = sum((F.col(c) * n for c, n in zip(parts, trees)), F.lit(0.0))
            return out.withColumn("prediction", total / float(sum(trees))).drop(*parts)
        for m, part in zip(self.models, parts):
            out = m.copy({m.rawPredictionCol: part, m.predictionCol: "", m.probabilityCol: ""}).transform(out)
            out = out.withColumn(part, vector_to_array(part))
        raw = F.col(parts[0])
        for part in parts[1:]:
            raw = F.zip_with(raw, F.col(part), lambda x, y: x + y)
        out = out.withColumn("__raw", raw).drop(*parts)
        all_ = F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x)
        best = F.array_position("__raw", F.array_max("__raw")) - 1
        return (out.withColumn("rawPrediction", array_to_vector("__raw"))
                .withColumn("probability", array_to_vector(F.transform("__raw", lambda x: x / all_)))
                .withColumn("prediction", best.cast("double")).drop("__raw"))

    @property
    def feature_importances(self):
        total = sum(m.featureImportances.toArray() * m.getNumTrees for m in self.models)
        return list(total / sum(m.getNumTrees for m in self.models))


def forest_classifier(num_trees: int = 300, max_depth: int = MAX_TREE_DEPTH, seed: int = 42, **kw):
    return ForestLearner(C.RandomForestClassifier, True, num_trees, max_depth, seed, "sqrt", **kw)


def forest_regressor(num_trees: int = 300, max_depth: int = MAX_TREE_DEPTH, seed: int = 42, **kw):
    return ForestLearner(R.RandomForestRegressor, False, num_trees, max_depth, seed, "all", **kw)


class GBTRegressorLearner:
    """Spark's gradient-boosted trees; many rows of few features are added up by the cells of a grid first."""

    probability = False

    def __init__(self, max_iter: int = 100, step: float = 0.1, max_depth: int = 3, seed: int = 42, **kw):
        self.seed, self.other = seed, kw
        self.kw = dict(maxIter=max_iter, stepSize=step, maxDepth=max_depth, seed=seed) | kw

    def fit(self, df, features_col="features", label_col="label"):
        from strata.operators import grid as G
        grid = None if self.other else G.make_grid(df, features_col, self.seed)
        if grid is None:
            return SparkFitted(R.GBTRegressor(featuresCol=features_col, labelCol=label_col, **self.kw).fit(df))
        cells = G.cell_rows(df, grid, features_col, label_col, classes=False).persist()
        try:
            return G.BinnedFitted(grid, SparkFitted(R.GBTRegressor(
                featuresCol=G.CELL_FEATURES, labelCol=label_col, weightCol=G.CELL_WEIGHT, **self.kw).fit(cells)), features_col)
        finally:
            cells.unpersist()


def gbt_regressor(max_iter: int = 100, step: float = 0.1, max_depth: int = 3, seed: int = 42, **kw):
    return GBTRegressorLearner(max_iter, step, max_depth, seed, **kw)


class GBTClassifierLearner:
    """Gradient-boosted trees: Spark's for two classes, one model on the multinomial
    deviance for more (``boost``)."""

    probability = True

    def __init__(self, max_iter=100, step=0.1, max_depth=3, seed=42):
        self.max_iter, self.step, self.max_depth, self.seed = max_iter, step, max_depth, seed

    def fit(self, df, features_col="features", label_col="label"):
        k = df.agg(F.max(label_col)).first()[0]
        k = int(k) + 1 if k is not None else 2
        if k <= 2:
            return SparkFitted(C.GBTClassifier(featuresCol=features_col, labelCol=label_col, maxIter=self.max_iter,
                                               stepSize=self.step, maxDepth=self.max_depth, seed=self.seed).fit(df))
        from strata.operators import grid as G
        from strata.operators.boost import SoftmaxBoost
        boost = SoftmaxBoost(k, self.max_iter, self.step, self.max_depth, self.seed)
        grid = G.make_grid(df, features_col, self.seed)
        if grid is None:
            return boost.fit(df, features_col, label_col)
        cells = G.cell_rows(df, grid, features_col, label_col, classes=True)
        return G.BinnedFitted(grid, boost.fit(cells, G.CELL_FEATURES, label_col, G.CELL_WEIGHT), features_col)


class LinearSVCLearner:
    """Linear support vector classifier (one-vs-rest beyond two classes, its machines
    fitted together: ``hinge``); the probability is a logistic fit on the decision margins (Platt scaling)."""

    probability = True

    def __init__(self, C_: float = 1.0, max_iter: int = 100):
        self.C_, self.max_iter = C_, max_iter

    def fit(self, df, features_col="features", label_col="label"):
        n = _count(df)
        k = int(df.agg(F.max(label_col)).first()[0] or 1) + 1
        reg = 1.0 / (self.C_ * max(n, 1))
        svc = C.LinearSVC(featuresCol=features_col, labelCol=label_col, regParam=reg,
                          maxIter=self.max_iter, standardization=False)
        if k <= 2:
            model = svc.fit(df)
        else:
            from strata.operators.hinge import fit_machines
            model = fit_machines(df, features_col, label_col, k, reg, self.max_iter) or C.OneVsRest(
                classifier=svc, featuresCol=features_col, labelCol=label_col, parallelism=min(k, OVR_PARALLELISM)).fit(df)
        from pyspark.ml.functions import array_to_vector
        scored = model.transform(df).withColumn("__m", array_to_vector(vector_to_array("rawPrediction"))) \
            .drop("prediction", "rawPrediction", "probability")
        platt = C.LogisticRegression(featuresCol="__m", labelCol=label_col, regParam=0.0, maxIter=100) \
            .fit(scored.select("__m", label_col))
        return _PlattFitted(model, platt)


class _PlattFitted:
    def __init__(self, model, platt):
        self.model, self.platt = model, platt

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        # the margins decide the class; the logistic fit on them gives the probability only
        out = self.model.transform(df).withColumn("__m", array_to_vector(vector_to_array("rawPrediction")))
        base = out.drop("rawPrediction", "probability").withColumnRenamed("prediction", "__class")
        p = self.platt.transform(base).drop("prediction").withColumnRenamed("__class", "prediction")
        keep = [c for c in p.columns if c not in ("__m", "rawPrediction")]
        return p.select(*keep)

    feature_importances = None


class SVCLearner:
    """Support vector classifier: radial kernel through landmark features, or linear.

    ``gamma`` is 'scale' or a number; ``landmarks`` bounds the rows that describe the kernel.
    The linear machine on the kernel features, its margins and their logistic fit are those
    of ``LinearSVCLearner``."""

    probability = True

    def __init__(self, C_: float = 1.0, kernel: str = "rbf", gamma: float | str = "scale", landmarks: int | None = None,
                 max_iter: int = 100):
        if kernel not in ("rbf", "linear"):
            raise ValueError(f"kernel must be 'rbf' or 'linear', not {kernel!r}")
        self.linear, self.kernel, self.gamma, self.landmarks = LinearSVCLearner(C_, max_iter), kernel, gamma, landmarks

    def fit(self, df, features_col="features", label_col="label"):
        if self.kernel == "linear":
            return self.linear.fit(df, features_col, label_col)
        from pyspark import StorageLevel

        from strata.operators.kernel import LANDMARKS, fit_kernel_map
        made = fit_kernel_map(df, features_col, self.gamma, self.landmarks or LANDMARKS)
        rows = made.transform(df.select(features_col, label_col), features_col, _KERNEL_COL).select(_KERNEL_COL, label_col)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _KernelFitted(made, self.linear.fit(rows, _KERNEL_COL, label_col), features_col)
        finally:
            rows.unpersist()


_KERNEL_COL = "__kernel_features"


class _KernelFitted:
    feature_importances = None

    def __init__(self, made, fitted, features_col):
        self.made, self.fitted, self.features_col = made, fitted, features_col

    def transform(self, df):
        return self.fitted.transform(self.made.transform(df, self.features_col, _KERNEL_COL)).drop(_KERNEL_COL)


def naive_bayes(var_smoothing: float = 1e-9, **kw):
    """Gaussian naive Bayes; Spark adds 1e-9 of the largest feature variance to each variance."""
    if var_smoothing != 1e-9:
        raise ValueError("var_smoothing is fixed at 1e-9")
    return SparkLearner(lambda df, fc, lc: C.NaiveBayes(featuresCol=fc, labelCol=lc, modelType="gaussian",
                                                        **kw), True)


def mlp(hidden: int = 100, max_iter: int = 500, seed: int = 42, **kw):
    def make(df, fc, lc):
        from pyspark.ml.linalg import VectorUDT  # noqa: F401
        d = len(df.select(fc).first()[0])
        k = int(df.agg(F.max(lc)).first()[0]) + 1
        return C.MultilayerPerceptronClassifier(featuresCol=fc, labelCol=lc, layers=[d, hidden, max(k, 2)],
                                                maxIter=max_iter, seed=seed, **kw)
    return SparkLearner(make, True)


def linear(**kw):
    return SparkLearner(lambda df, fc, lc: R.LinearRegression(featuresCol=fc, labelCol=lc, regParam=0.0,
                                                              **kw), False)


def ridge(alpha: float = 1.0, **kw):
    """L2: regParam = alpha·sd(label)/n with L-BFGS and no standardisation."""
    def make(df, fc, lc):
        n, sd = _count(df), _label_sd(df, lc)
        return R.LinearRegression(featuresCol=fc, labelCol=lc, regParam=alpha * sd / max(n, 1),
                                  elasticNetParam=0.0, solver="l-bfgs", standardization=False, **kw)
    return SparkLearner(make, False)


def lasso(alpha: float = 1.0, **kw):
    return SparkLearner(lambda df, fc, lc: R.LinearRegression(
        featuresCol=fc, labelCol=lc, regParam=alpha, elasticNetParam=1.0, solver="l-bfgs",
        standardization=False, **kw), False)


def elastic_net(alpha: float = 1.0, l1_ratio: float = 0.5, **kw):
    def make(df, fc, lc):
        sd = _label_sd(df, lc)
        a, b = alpha * l1_ratio, alpha * (1 - l1_ratio) * sd
        return R.LinearRegression(featuresCol=fc, labelCol=lc, regParam=a + b,
                                  elasticNetParam=a / (a + b) if a + b else 0.0, solver="l-bfgs",
                                  standardization=False, **kw)
    return SparkLearner(make, False)


# ---------------------------------------------------------------------------
# AdaBoost (SAMME) and AdaBoost.R2 as loops of weighted Spark trees
# ---------------------------------------------------------------------------

def _next_round(last: DataFrame, data: DataFrame, cut: bool) -> DataFrame:
    """The next round's weights, held in memory or on disk; the last round's are given up.
    ``cut`` also cuts the lineage with a reliable checkpoint."""
    if cut:
        data = data.checkpoint(eager=True)
    else:
        data = data.persist()
        data.count()
    last.unpersist()
    return data


class AdaBoostClassifierLearner:
    """SAMME with depth-1 trees fitted on instance weights; the weights are a
    column updated by an expression each round, lineage cut by a reliable
    checkpoint every ``checkpoint_every`` rounds."""

    probability = True

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 1,
                 seed: int = 42, checkpoint_every: int = 10):
        self.n, self.lr, self.depth, self.seed, self.ck = n_estimators, learning_rate, max_depth, seed, checkpoint_every

    def fit(self, df, features_col="features", label_col="label"):
        ensure_checkpoint_dir(df.sparkSession)
        k = int(df.agg(F.max(label_col)).first()[0]) + 1
        k = max(k, 2)
        n = df.count()
        data = df.select(features_col, label_col).withColumn("__w", F.lit(1.0 / n))
        models, alphas = [], []
        for m in range(self.n):
            tree = C.DecisionTreeClassifier(featuresCol=features_col, labelCol=label_col, weightCol="__w",
                                            maxDepth=self.depth, seed=self.seed + m).fit(data)
            pred = tree.transform(data).select(features_col, label_col, "__w",
                                               (F.col("prediction") != F.col(label_col)).alias("__miss"))
            st = pred.agg(F.sum(F.when(F.col("__miss"), F.col("__w")).otherwise(0.0)).alias("e"),
                          F.sum("__w").alias("t")).first()
            err = (st["e"] or 0.0) / st["t"]
            if err <= 0:
                models.append(tree)
                alphas.append(1.0)
                break
            if err >= 1 - 1.0 / k:
                if not models:
                    models.append(tree)
                    alphas.append(1.0)
                break
            alpha = self.lr * (math.log((1 - err) / err) + math.log(k - 1))
            models.append(tree)
            alphas.append(alpha)
            # the new total follows from the two masses already aggregated
            total = (st["t"] - (st["e"] or 0.0)) + (st["e"] or 0.0) * math.exp(alpha)
            data = _next_round(data, pred.select(
                features_col, label_col,
                (F.col("__w") * F.when(F.col("__miss"), F.lit(math.exp(alpha))).otherwise(1.0)
                 / F.lit(total)).alias("__w")), (m + 1) % self.ck == 0)
        return _AdaFitted(models, alphas, k)


class _AdaFitted:
    def __init__(self, models, alphas, k):
        self.models, self.alphas, self.k = models, alphas, k

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        k, total = self.k, sum(self.alphas)
        out = df
        votes = []
        for i, (m, a) in enumerate(zip(self.models, self.alphas)):
            m2 = m.copy({m.predictionCol: f"__p{i}", m.rawPredictionCol: f"__r{i}",
                         m.probabilityCol: f"__q{i}"})
            out = m2.transform(out).drop(f"__r{i}", f"__q{i}")
            votes.append((F.col(f"__p{i}"), a))
        # decision_k = Σ a·(1 if h = k else −1/(k−1)) / Σ a
        dec = [sum(((F.when(p == F.lit(float(c)), F.lit(a)).otherwise(F.lit(-a / (k - 1)))) for p, a in votes),
                   F.lit(0.0)) / F.lit(total) for c in range(k)]
        arr = F.array(*dec)
        pred = F.array_position(arr, F.array_max(arr)) - 1
        ex = F.transform(arr, lambda x: F.exp(x / F.lit(float(k - 1))))
        s = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
        out = out.withColumn("prediction", pred.cast("double")) \
            .withColumn("probability", array_to_vector(F.transform(ex, lambda x: x / s)))
        return out.drop(*[f"__p{i}" for i in range(len(self.models))])

    @property
    def feature_importances(self):
        import numpy as np
        imps = [a * m.featureImportances.toArray() for m, a in zip(self.models, self.alphas)]
        tot = sum(self.alphas)
        return list(np.sum(imps, axis=0) / tot) if imps else None


class AdaBoostRegressorLearner:
    """AdaBoost.R2 (linear loss) with depth-3 regression trees fitted on
    weights; prediction is the alpha-weighted median of the trees."""

    probability = False

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 3,
                 seed: int = 42, checkpoint_every: int = 10):
        self.n, self.lr, self.depth, self.seed, self.ck = n_estimators, learning_rate, max_depth, seed, checkpoint_every

    def fit(self, df, features_col="features", label_col="label"):
        ensure_checkpoint_dir(df.sparkSession)
        n = df.count()
        data = df.select(features_col, label_col).withColumn("__w", F.lit(1.0 / n))
        models, alphas = [], []
        for m in range(self.n):
            tree = R.DecisionTreeRegressor(featuresCol=features_col, labelCol=label_col, weightCol="__w",
                                           maxDepth=self.depth, seed=self.seed + m).fit(data)
            pred = tree.transform(data).withColumn("__e", F.abs(F.col("prediction") - F.col(label_col)))
            mx = pred.agg(F.max("__e")).first()[0] or 0.0
            if mx == 0:
                models.append(tree)
                alphas.append(1.0)
                break
            pred = pred.withColumn("__e", F.col("__e") / F.lit(mx))
            avg = pred.agg(F.sum(F.col("__w") * F.col("__e")) / F.sum("__w")).first()[0]
            if avg >= 0.5:
                if not models:
                    models.append(tree)
                    alphas.append(1.0)
                break
            beta = avg / (1 - avg) if avg > 0 else 1e-12
            alpha = self.lr * math.log(1 / beta)
            models.append(tree)
            alphas.append(alpha)
            upd = pred.select(features_col, label_col,
                              (F.col("__w") * F.pow(F.lit(beta), (1 - F.col("__e")) * self.lr)).alias("__w"))
            total = upd.agg(F.sum("__w")).first()[0]
            data = _next_round(data, upd.withColumn("__w", F.col("__w") / F.lit(total)), (m + 1) % self.ck == 0)
        return _AdaRegFitted(models, alphas)


class _AdaRegFitted:
    def __init__(self, models, alphas):
        self.models, self.alphas = models, alphas

    def transform(self, df):
        out = df
        for i, m in enumerate(self.models):
            out = m.copy({m.predictionCol: f"__p{i}"}).transform(out)
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"__p{i}").alias("p"), F.lit(a).alias("a"))
                                        for i, a in enumerate(self.alphas)]))
        half = 0.5 * sum(self.alphas)
        # first prediction whose cumulative weight reaches half the total
        cum = F.aggregate(pairs, F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v")),
                          lambda acc, x: F.struct((acc["c"] + x["a"]).alias("c"),
                                                  F.when(acc["v"].isNull() & (acc["c"] + x["a"] >= F.lit(half)),
                                                         x["p"]).otherwise(acc["v"]).alias("v")))
        out = out.withColumn("prediction", cum["v"])
        return out.drop(*[f"__p{i}" for i in range(len(self.models))])

    @property
    def feature_importances(self):
        import numpy as np
        imps = [a * m.featureImportances.toArray() for m, a in zip(self.models, self.alphas)]
        return list(np.sum(imps, axis=0) / sum(self.alphas)) if imps else None


class KNNLearner:
    """Exact k nearest neighbours (see ``strata.operators.knn``)."""

    def __init__(self, k: int = 5, problem: str = "classification", id_col: str = "__row_id"):
        self.k, self.problem, self.id_col = k, problem, id_col
        self.probability = problem == "classification"

    def fit(self, df, features_col="features", label_col="label"):
        from strata.operators.knn import fit_knn
        ids = df if self.id_col in df.columns else df.withColumn(self.id_col, F.monotonically_increasing_id())
        return _KNNFitted(fit_knn(ids, features_col, label_col, self.id_col, self.k, self.problem), self.id_col)


class _KNNFitted:
    """A k-NN model; its training blocks are its parameters."""

    feature_importances = None

    def __init__(self, model, id_col):
        self.model, self.id_col = model, id_col

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        out = self.model.transform(df)
        if "probability" in out.columns:
            out = out.withColumn("probability", array_to_vector("probability"))
        return out.drop("predicted_label")


# ---------------------------------------------------------------------------
# registry
# ---------------------------------------------------------------------------

@dataclass
class ModelDefinition:
    name: str
    problem_type: str
    category: str
    factory: Callable[..., Any]
    default_parameters: dict = field(default_factory=dict)
    supports_feature_importance: bool = False
    supports_probability: bool = False
    supports_shap: bool = False


def _registry() -> dict[str, ModelDefinition]:
    D = ModelDefinition
    cls = [
        D("Logistic Regression", "classification", "Linear", logistic, {"max_iter": 1000},
          supports_probability=True),
        D("Decision Tree", "classification", "Tree", tree_classifier, {"seed": 42}, True, True, True),
        D("Random Forest", "classification", "Ensemble", forest_classifier, {"num_trees": 300, "seed": 42},
          True, True, True),
        D("Gradient Boosting", "classification", "Boosting", GBTClassifierLearner, {"seed": 42}, True, True, True),
        D("AdaBoost", "classification", "Boosting", AdaBoostClassifierLearner, {"seed": 42},
          supports_probability=True),
        D("Support Vector Machine", "classification", "Kernel", SVCLearner, {},
          supports_probability=True),
        D("K-Nearest Neighbours", "classification", "Distance",
          lambda **kw: KNNLearner(problem="classification", **kw), {"k": 5}, supports_probability=True),
        D("Naive Bayes", "classification", "Probabilistic", naive_bayes, {}, supports_probability=True),
        D("Multi-layer Perceptron", "classification", "Neural Network", mlp, {"hidden": 100, "max_iter": 500,
                                                                             "seed": 42},
          supports_probability=True),
    ]
    reg = [
        D("Linear Regression", "regression", "Linear", linear, {}),
        D("Ridge Regression", "regression", "Linear", ridge, {"alpha": 1.0}),
        D("Lasso Regression", "regression", "Linear", lasso, {"alpha": 1.0}),
        D("Elastic Net", "regression", "Linear", elastic_net, {"alpha": 1.0, "l1_ratio": 0.5}),
        D("Decision Tree Regressor", "regression", "Tree", tree_regressor, {"seed": 42}, True, False, True),
        D("Random Forest Regressor", "regression", "Ensemble", forest_regressor, {"num_trees": 300, "seed": 42},
          True, False, True),
        D("Gradient Boosting Regressor", "regression", "Boosting", gbt_regressor, {"seed": 42}, True, False, True),
        D("AdaBoost Regressor", "regression", "Boosting", AdaBoostRegressorLearner, {"seed": 42}),
        D("K-Nearest Neighbours Regressor", "regression", "Distance",
          lambda **kw: KNNLearner(problem="regression", **kw), {"k": 5}),
    ]
    return {"classification": {d.name: d for d in cls}, "regression": {d.name: d for d in reg}}


REGISTRY = _registry()


def _problem_key(problem: str) -> str:
    p = problem.lower()
    if p == "time_series":
        raise ValueError("time_series is a detection label only; choose classification or regression.")
    return "classification" if p == "classification" else "regression"


def available_models(problem: str) -> list[str]:
    return sorted(REGISTRY[_problem_key(problem)])


def get_model_definition(name: str, problem: str) -> ModelDefinition:
    models = REGISTRY[_problem_key(problem)]
    if name not in models:
        raise ValueError(f"Unknown model '{name}' for {problem}.")
    return models[name]


def create_model(name: str, problem: str, **overrides):
    d = get_model_definition(name, problem)
    params = dict(d.default_parameters)
    params.update(overrides)
    return d.factory(**params)


def model_supports_feature_importance(name: str, problem: str) -> bool:
    return get_model_definition(name, problem).supports_feature_importance


def model_supports_probability(name: str, problem: str) -> bool:
    return get_model_definition(name, problem).supports_probability


def model_supports_shap(name: str, problem: str) -> bool:
    return get_model_definition(name, problem).supports_shap


# ---------------------------------------------------------------------------
# saving and loading fitted learners
# ---------------------------------------------------------------------------

def write_json(spark, doc: dict, path: str) -> None:
    """A small record as one text file, through Spark's file systems."""
    import json
    spark.createDataFrame([(json.dumps(doc, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark, path: str) -> dict:
    import json
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _margin_stages(fitted: _PlattFitted) -> tuple[list, dict | None]:
    """The Spark models of a classifier by margins, and its machines where they are not one of these."""
    if hasattr(fitted.model, "document"):
        return [fitted.platt], fitted.model.document()
    return [fitted.model, fitted.platt], None


def _margins_of(stages: list, doc: dict) -> _PlattFitted:
    if doc.get("machines"):
        from strata.operators.hinge import Machines
        stages = [Machines.from_document(doc["machines"]), *stages]
    return _PlattFitted(*stages)


def save_fitted(spark, fitted, path: str) -> None:
    """Write any fitted learner of the registry."""
    kind = type(fitted).__name__
    doc, stages = {"kind": kind}, []
    if isinstance(fitted, SparkFitted):
        stages = [fitted.model]
    elif isinstance(fitted, _PlattFitted):
        stages, doc["machines"] = _margin_stages(fitted)
    elif isinstance(fitted, _KernelFitted):
        (stages, doc["machines"]), doc["kernel"] = _margin_stages(fitted.fitted), fitted.made.document()
        doc["features_col"] = fitted.features_col
    elif kind == "SoftmaxBoosted":
        doc["boosted"] = fitted.document()
    elif kind == "GridForest":
        doc["forest"] = fitted.document()
    elif kind == "PieceForest":
        doc["pieces"] = fitted.document()
        spark.read.parquet(fitted.path).write.mode("overwrite").parquet(f"{path}/pieces")
    elif kind == "BinnedFitted":
        doc["ends"], doc["features_col"] = fitted.grid.ends, fitted.features_col
        save_fitted(spark, fitted.fitted, f"{path}/inner")
    elif isinstance(fitted, ForestFitted):
        stages = fitted.models
    elif isinstance(fitted, (_AdaFitted, _AdaRegFitted)):
        stages, doc["alphas"], doc["k"] = fitted.models, fitted.alphas, getattr(fitted, "k", None)
    elif isinstance(fitted, _KNNFitted):
        from strata.operators.knn import write_cells
        m = fitted.model
        write_cells(spark.read.parquet(f"{m.path}/rows"), spark.read.parquet(f"{m.path}/pivots"), f"{path}/blocks")
        doc |= {"k": m.k, "problem": m.problem, "dim": m.dim, "labels": m.labels, "features_col": m.features_col,
                "label_col": m.label_col, "knn_id": m.id_col, "id_col": fitted.id_col}
    else:
        raise TypeError(f"{type(fitted).__name__} cannot be saved")
    for i, stage in enumerate(stages):
        stage.write().overwrite().save(f"{path}/stage{i}")
    write_json(spark, doc | {"stages": len(stages)}, f"{path}/fitted")


def load_fitted(spark, path: str):
    from pyspark.ml.util import DefaultParamsReader
    doc = read_json(spark, f"{path}/fitted")
    stages = [DefaultParamsReader.loadParamsInstance(f"{path}/stage{i}", spark.sparkContext)
              for i in range(doc["stages"])]
    kind = doc["kind"]
    if kind == "SparkFitted":
        return SparkFitted(stages[0])
    if kind == "ForestFitted":
        return ForestFitted(stages)
    if kind == "_KernelFitted":
        from strata.operators.kernel import KernelMap
        return _KernelFitted(KernelMap.from_document(doc["kernel"]), _margins_of(stages, doc), doc["features_col"])
    if kind == "_PlattFitted":
        return _margins_of(stages, doc)
    if kind == "SoftmaxBoosted":
        from strata.operators.boost import SoftmaxBoosted
        return SoftmaxBoosted.from_document(doc["boosted"])
    if kind == "GridForest":
        from strata.operators.grid import GridForest
        return GridForest.from_document(doc["forest"])
    if kind == "PieceForest":
        from strata.operators.forest import PieceForest
        return PieceForest.from_document(spark, doc["pieces"], f"{path}/pieces")
    if kind == "BinnedFitted":
        from strata.operators.grid import BinnedFitted, Grid
        return BinnedFitted(Grid(doc["ends"]), load_fitted(spark, f"{path}/inner"), doc["features_col"])
    if kind == "_AdaFitted":
        return _AdaFitted(stages, doc["alphas"], doc["k"])
    if kind == "_AdaRegFitted":
        return _AdaRegFitted(stages, doc["alphas"])
    from strata.operators.knn import KNNModel, open_cells
    return _KNNFitted(KNNModel(f"{path}/blocks", doc["k"], doc["problem"], doc["dim"], doc["labels"],
                               doc["features_col"], doc["label_col"], doc["knn_id"], open_cells(spark, f"{path}/blocks")), doc["id_col"])
