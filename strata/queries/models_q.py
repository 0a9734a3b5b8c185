"""Model queries: fit on the training split of a driver
table, return predictions (or fitted quantities) for the test split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import models as M
from strata.plans import train as TR
from strata.queries import register, table
from strata.session import scratch_path

_NO_CV = TR.TrainConfig(cross_validation=False)


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source") \
        .join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _line(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               "l_quantity", "l_discount", "l_tax", "l_extendedprice")


_LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
_LINE_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _preds(res: TR.TrainingResult, id_cols) -> DataFrame:
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    pred = res.labels.to_label(F.col("prediction")) if res.labels else F.col("prediction")
    return res.predictions.select(*ids, F.col(res.target).alias("actual"), pred.alias("prediction"))


def _cls(spark, sf, name, **kw):
    res = TR.train_model(_emb(spark, sf), "label", name, "classification", ["embedding"], "vec_id", _NO_CV,
                         overrides=kw)
    return _preds(res, "vec_id")


def _reg(spark, sf, name, **kw):
    res = TR.train_model(_line(spark, sf), "l_extendedprice", name, "regression", _LINE_FEATS, _LINE_ID,
                         _NO_CV, overrides=kw)
    return _preds(res, _LINE_ID)


@register("fit_logistic")
def fit_logistic(spark, sf):
    return _cls(spark, sf, "Logistic Regression")


@register("fit_tree")
def fit_tree(spark, sf):
    return _cls(spark, sf, "Decision Tree")


@register("fit_forest")
def fit_forest(spark, sf):
    return _cls(spark, sf, "Random Forest")


@register("fit_gbt")
def fit_gbt(spark, sf):
    res = TR.train_model(_docs(spark, sf), "quality", "Gradient Boosting", "classification",
                         ["n_chars", "lang", "source"], "doc_id", _NO_CV)
    return _preds(res, "doc_id")


@register("fit_gbt_multiclass")
def fit_gbt_multiclass(spark, sf):
    """Twenty rounds of multinomial boosting of the three order states; predictions of the test rows."""
    res = TR.train_model(table(spark, sf, "orders"), "o_orderstatus", "Gradient Boosting", "classification",
                         ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderkey", _NO_CV,
                         overrides={"max_iter": 20})
    return _preds(res, "o_orderkey")


@register("fit_adaboost")
def fit_adaboost(spark, sf):
    res = TR.train_model(_docs(spark, sf), "quality", "AdaBoost", "classification",
                         ["n_chars", "lang", "source"], "doc_id", _NO_CV)
    return _preds(res, "doc_id")


@register("fit_linear_svc")
def fit_linear_svc(spark, sf):
    return _cls(spark, sf, "Support Vector Machine", kernel="linear")


@register("fit_svc")
def fit_svc(spark, sf):
    """Support vector machine with the radial kernel (the default)."""
    return _cls(spark, sf, "Support Vector Machine")


_KNN_SQL = """
WITH e AS (SELECT vec_id, embedding, label, md5(CAST(vec_id AS VARCHAR) || ':42') < '33333333' AS is_test
           FROM embeddings),
tr AS (SELECT * FROM e WHERE NOT is_test), te AS (SELECT * FROM e WHERE is_test),
d AS (SELECT te.vec_id AS qid, te.label AS actual, tr.vec_id AS tid, tr.label AS tlabel,
        list_sum(list_transform(list_zip(te.embedding, tr.embedding),
                 lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))
          AS dist
      FROM te, tr),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
v AS (SELECT qid, actual, tlabel, COUNT(*) AS n FROM r WHERE rn <= 5 GROUP BY qid, actual, tlabel),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tlabel) AS rk FROM v)
SELECT qid AS vec_id, actual, tlabel AS prediction FROM w WHERE rk = 1"""


@register("fit_knn", _KNN_SQL)
def fit_knn(spark, sf):
    return _cls(spark, sf, "K-Nearest Neighbours")


_NB_SQL = """
WITH e AS (SELECT vec_id, label, embedding, md5(CAST(vec_id AS VARCHAR) || ':42') < '33333333' AS is_test FROM embeddings),
x AS (SELECT vec_id, label, is_test, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS j FROM e),
eps AS (SELECT 1e-9 * MAX(v) AS eps FROM (SELECT VAR_POP(v) AS v FROM x WHERE NOT is_test GROUP BY j)),
m AS (SELECT label, j, AVG(v) AS mu, VAR_POP(v) + (SELECT eps FROM eps) AS s2 FROM x WHERE NOT is_test GROUP BY label, j),
p AS (SELECT label, LN(COUNT(*) * 1.0 / SUM(COUNT(*)) OVER ()) AS lp FROM e WHERE NOT is_test GROUP BY label),
s AS (SELECT x.vec_id, x.label AS actual, m.label AS c, MAX(p.lp) + SUM(-0.5 * LN(2 * PI() * s2) - (v - mu) * (v - mu) / (2 * s2)) AS ll
      FROM x JOIN m USING (j) JOIN p ON p.label = m.label WHERE x.is_test GROUP BY x.vec_id, x.label, m.label)
SELECT vec_id, actual, c AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC) AS r FROM s)
WHERE r = 1"""


@register("fit_naive_bayes", _NB_SQL)
def fit_naive_bayes(spark, sf):
    return _cls(spark, sf, "Naive Bayes")


@register("fit_mlp")
def fit_mlp(spark, sf):
    return _cls(spark, sf, "Multi-layer Perceptron")


@register("fit_linear", """
SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def fit_linear(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label")))
    fitted = M.create_model("Linear Regression", "regression").fit(d)
    m = fitted.model
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double") \
        .select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@register("fit_ridge")
def fit_ridge(spark, sf):
    return _reg(spark, sf, "Ridge Regression")


@register("fit_lasso")
def fit_lasso(spark, sf):
    return _reg(spark, sf, "Lasso Regression")


@register("fit_elastic_net")
def fit_elastic_net(spark, sf):
    return _reg(spark, sf, "Elastic Net")


@register("fit_tree_regressor")
def fit_tree_regressor(spark, sf):
    return _reg(spark, sf, "Decision Tree Regressor")


@register("fit_forest_regressor")
def fit_forest_regressor(spark, sf):
    return _reg(spark, sf, "Random Forest Regressor")


@register("fit_gbt_regressor")
def fit_gbt_regressor(spark, sf):
    return _reg(spark, sf, "Gradient Boosting Regressor")


@register("fit_adaboost_regressor")
def fit_adaboost_regressor(spark, sf):
    return _reg(spark, sf, "AdaBoost Regressor")


_KNN_REG_SQL = _KNN_SQL.split("v AS (SELECT qid")[0].replace("tr.label AS tlabel", "CAST(tr.label AS DOUBLE) AS tlabel") \
    .rstrip().rstrip(",") + """
SELECT qid AS vec_id, CAST(actual AS DOUBLE) AS actual, ROUND(AVG(tlabel), 9) AS prediction FROM r WHERE rn <= 5
GROUP BY qid, actual"""


@register("fit_knn_regressor", _KNN_REG_SQL)
def fit_knn_regressor(spark, sf):
    """Mean label (as a number) of the five nearest embeddings."""
    d = _emb(spark, sf).withColumn("label", F.col("label").cast("double"))
    res = TR.train_model(d, "label", "K-Nearest Neighbours Regressor", "regression", ["embedding"], "vec_id", _NO_CV)
    return _preds(res, "vec_id").withColumn("prediction", F.round("prediction", 9))


@register("train_model")
def train_model(spark, sf):
    """Logistic regression on the documents ⋈ labels quality target, with
    5-fold stratified cross-validation; returns the training summary."""
    res = TR.train_model(_docs(spark, sf), "quality", "Logistic Regression", "classification",
                         ["n_chars", "lang", "source"], "doc_id", TR.TrainConfig())
    cv = TR.cross_validation_summary(res.cross_validation).select(
        "Metric", F.format_number("Mean", 4).alias("Value"))
    return TR.training_summary(res).unionByName(cv)


@register("tune")
def tune(spark, sf):
    cfg = TR.TrainConfig(cross_validation=False, hyperparameter_tuning=True, cv_folds=5)
    res = TR.train_model(_docs(spark, sf), "quality", "Decision Tree", "classification",
                         ["n_chars", "lang", "source"], "doc_id", cfg, grid={"max_depth": [2, 4, 8]})
    return spark.createDataFrame([(k, str(v)) for k, v in res.best_parameters.items()],
                                 "parameter string, value string").unionByName(
        _preds(res, "doc_id").agg(F.count(F.lit(1)).cast("string").alias("value"))
        .select(F.lit("test_rows").alias("parameter"), "value"))


@register("sink_model", _KNN_SQL.replace("SELECT qid AS vec_id, actual, tlabel AS prediction FROM w WHERE rk = 1",
                                         "SELECT qid AS vec_id, tlabel AS prediction FROM w WHERE rk = 1"))
def sink_model(spark, sf):
    """A registry model saved with its preparation and labels, loaded again and used to predict."""
    res = TR.train_model(_emb(spark, sf), "label", "K-Nearest Neighbours", "classification", ["embedding"], "vec_id",
                         _NO_CV)
    loaded = TR.load_result(spark, TR.save_result(res, scratch_path(spark, "model")))
    return TR.predict(loaded, res.test).select("vec_id", F.col("Prediction").alias("prediction"))


def _trained_docs(spark, sf, name="Random Forest", **kw):
    return TR.train_model(_docs(spark, sf), "quality", name, "classification",
                          ["n_chars", "lang", "source"], "doc_id", _NO_CV, overrides=kw)


@register("predict")
def predict(spark, sf):
    """Score all documents that have no label with the quality model; the
    scoring table lacks the ``source`` feature (filled)."""
    res = _trained_docs(spark, sf)
    unlabeled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti") \
        .select("doc_id", "n_chars", "lang", "text")
    return TR.predict(res, unlabeled).drop("text")


@register("prediction_summary", """
SELECT COUNT(*) AS rows_predicted, TRUE AS probabilities, CAST(6 AS BIGINT) AS output_columns FROM documents""")
def prediction_summary(spark, sf):
    res = _trained_docs(spark, sf)
    return TR.prediction_summary(TR.predict(res, table(spark, sf, "documents").select("doc_id", "n_chars", "lang")))


@register("feature_importance")
def feature_importance(spark, sf):
    res = _trained_docs(spark, sf)
    return TR.feature_importance(res)


@register("permutation_importance")
def permutation_importance(spark, sf):
    res = TR.train_model(_docs(spark, sf), "quality", "Logistic Regression", "classification",
                         ["n_chars", "lang"], "doc_id", _NO_CV)
    return TR.permutation_importance(res, res.test, "doc_id", repeats=10)


@register("evaluate")
def evaluate(spark, sf):
    res = TR.train_model(_emb(spark, sf), "label", "Logistic Regression", "classification", ["embedding"],
                         "vec_id", _NO_CV)
    ev = TR.evaluate_model(res)
    parts = [ev["metrics"].select(F.lit("metrics").alias("section"), F.to_json(F.struct("*")).alias("value")),
             ev["confusion_matrix"].select(F.lit("confusion_matrix").alias("section"),
                                           F.to_json(F.struct("*")).alias("value")),
             ev["classification_report"].select(F.lit("report").alias("section"),
                                                F.to_json(F.struct("*")).alias("value"))]
    if ev.get("roc_auc") is not None:
        parts.append(ev["roc_auc"].select(F.lit("roc_auc").alias("section"), F.to_json(F.struct("*")).alias("value")))
    if ev.get("feature_importance") is not None:
        parts.append(ev["feature_importance"].select(F.lit("importance").alias("section"),
                                                     F.to_json(F.struct("*")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


_LINEAR_CV = [{"model": "linear"}, {"model": "ridge", "alpha": 50.0}, {"model": "ridge", "alpha": 5000.0}]


@register("cross_validate_linear", """
WITH s AS (
  SELECT l_orderkey % 5 AS fold, CAST(COUNT(*) AS DOUBLE) AS n, SUM(l_quantity) AS q, SUM(l_discount) AS d, SUM(l_extendedprice) AS y,
         SUM(l_quantity * l_quantity) AS qq, SUM(l_discount * l_discount) AS dd, SUM(l_quantity * l_discount) AS qd,
         SUM(l_quantity * l_extendedprice) AS qy, SUM(l_discount * l_extendedprice) AS dy,
         SUM(l_extendedprice * l_extendedprice) AS yy
  FROM lineitem GROUP BY 1),
a AS (SELECT SUM(n) AS n, SUM(q) AS q, SUM(d) AS d, SUM(y) AS y, SUM(qq) AS qq, SUM(dd) AS dd, SUM(qd) AS qd, SUM(qy) AS qy,
             SUM(dy) AS dy FROM s),
c AS (SELECT * FROM (VALUES (0, 'linear', 0.0), (1, 'ridge', 50.0), (2, 'ridge', 5000.0)) AS c(candidate, model, alpha)),
t AS (
  SELECT s.*, a.n - s.n AS tn, (a.q - s.q) / (a.n - s.n) AS mq, (a.d - s.d) / (a.n - s.n) AS md, (a.y - s.y) / (a.n - s.n) AS my,
         a.qq - s.qq AS tqq, a.dd - s.dd AS tdd, a.qd - s.qd AS tqd, a.qy - s.qy AS tqy, a.dy - s.dy AS tdy
  FROM s, a),
m AS (
  SELECT t.*, c.*, tqq - tn * mq * mq + alpha AS g11, tdd - tn * md * md + alpha AS g22, tqd - tn * mq * md AS g12,
         tqy - tn * mq * my AS b1, tdy - tn * md * my AS b2
  FROM t, c),
w AS (SELECT *, (b1 * g22 - b2 * g12) / (g11 * g22 - g12 * g12) AS w1, (b2 * g11 - b1 * g12) / (g11 * g22 - g12 * g12) AS w2 FROM m),
e AS (SELECT *, my - w1 * mq - w2 * md AS w0 FROM w),
r AS (
  SELECT *, yy + n * w0 * w0 + w1 * w1 * qq + w2 * w2 * dd - 2 * w0 * y - 2 * w1 * qy - 2 * w2 * dy + 2 * w0 * w1 * q
            + 2 * w0 * w2 * d + 2 * w1 * w2 * qd AS sse
  FROM e)
SELECT CAST(candidate AS INTEGER) AS candidate, model, CAST(fold AS INTEGER) AS fold, CAST(n AS BIGINT) AS rows,
       ROUND(1 - sse / (yy - y * y / n), 6) AS r2, ROUND(SQRT(sse / n), 2) AS rmse
FROM r""")
def cross_validate_linear(spark, sf):
    """Least squares and two ridge penalties on five folds of ``lineitem``, all from one scan."""
    from strata.operators.gram import cross_validate_linear as run
    d = table(spark, sf, "lineitem").select("l_orderkey", F.array("l_quantity", "l_discount").alias("x"), "l_extendedprice")
    out = run(d, "x", "l_extendedprice", F.col("l_orderkey") % 5, _LINEAR_CV)
    return out.select("candidate", "model", "fold", "rows", F.round("r2", 6).alias("r2"), F.round(F.sqrt("mse"), 2).alias("rmse"))
