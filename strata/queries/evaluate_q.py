"""Split, fold and evaluation-metric queries on deterministic predictions
(SURVEY §2.10 splits, §2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import evaluate as EV
from strata.operators import split as SP
from strata.queries import register, table
from strata.queries.common import round_doubles
from strata.sources.writers import metrics_table as _metrics_table

_PRED_SQL = ("SELECT l_returnflag AS actual, CASE WHEN l_quantity > 25 THEN 'A' ELSE 'N' END AS predicted "
             "FROM lineitem")


def _cls_preds(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("actual"),
        F.when(F.col("l_quantity") > 25, "A").otherwise("N").alias("predicted"))


_CM_SQL = f"""WITH p AS ({_PRED_SQL}),
labels AS (SELECT actual AS l FROM p UNION SELECT predicted FROM p),
cm AS (SELECT a.l AS actual, b.l AS predicted,
         (SELECT COUNT(*) FROM p WHERE p.actual = a.l AND p.predicted = b.l) AS n
       FROM labels a, labels b)"""
_PC_SQL = _CM_SQL + """,
pc AS (SELECT l AS label,
  (SELECT n FROM cm WHERE actual = l AND predicted = l) AS tp,
  (SELECT SUM(n) FROM cm WHERE predicted = l) AS pn,
  (SELECT SUM(n) FROM cm WHERE actual = l) AS support FROM labels),
pm AS (SELECT *, COALESCE(tp * 1.0 / NULLIF(pn, 0), 0.0) AS prec, COALESCE(tp * 1.0 / NULLIF(support, 0), 0.0) AS rec
       FROM pc),
pf AS (SELECT *, COALESCE(2 * prec * rec / NULLIF(prec + rec, 0), 0.0) AS f1 FROM pm)"""


@register("confusion_matrix", _CM_SQL + " SELECT actual, predicted, CAST(n AS BIGINT) AS n FROM cm")
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(_cls_preds(spark, sf), "actual", "predicted")


@register("classification_metrics", _PC_SQL + """
SELECT ROUND(SUM(tp) / SUM(support), 9) AS accuracy, ROUND(SUM(prec * support) / SUM(support), 9) AS precision,
       ROUND(SUM(rec * support) / SUM(support), 9) AS recall, ROUND(SUM(f1 * support) / SUM(support), 9) AS f1
FROM pf""")
def classification_metrics(spark, sf):
    return round_doubles(EV.classification_metrics(_cls_preds(spark, sf), "actual", "predicted"), 9)


@register("classification_report", _PC_SQL + """
SELECT label, ROUND(prec, 4) AS precision, ROUND(rec, 4) AS recall, ROUND(f1, 4) AS f1_score,
       ROUND(CAST(support AS DOUBLE), 4) AS support FROM pf
UNION ALL SELECT 'accuracy', ROUND(SUM(tp) / SUM(support), 4), ROUND(SUM(tp) / SUM(support), 4),
       ROUND(SUM(tp) / SUM(support), 4), ROUND(SUM(tp) / SUM(support), 4) FROM pf
UNION ALL SELECT 'macro avg', ROUND(AVG(prec), 4), ROUND(AVG(rec), 4), ROUND(AVG(f1), 4),
       ROUND(SUM(support), 4) FROM pf
UNION ALL SELECT 'weighted avg', ROUND(SUM(prec * support) / SUM(support), 4), ROUND(SUM(rec * support) / SUM(support), 4),
       ROUND(SUM(f1 * support) / SUM(support), 4), ROUND(SUM(support), 4) FROM pf""")
def classification_report(spark, sf):
    return EV.classification_report(_cls_preds(spark, sf), "actual", "predicted")


_SCORE_SQL = ("SELECT CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y, "
              "CAST((o_orderkey % 100) / 100.0 AS DOUBLE) AS score FROM orders")


def _scores(spark, sf):
    return table(spark, sf, "orders").select(
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("y"),
        ((F.col("o_orderkey") % 100) / F.lit(100.0)).cast("double").alias("score"))


@register("roc_auc", f"""
WITH s AS ({_SCORE_SQL}),
r AS (SELECT y, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT ROUND((SUM(CASE WHEN y = 1 THEN rk ELSE 0 END) - SUM(y) * (SUM(y) + 1) / 2.0)
             / (SUM(y) * (COUNT(*) - SUM(y))), 9) AS roc_auc FROM r""")
def roc_auc(spark, sf):
    return round_doubles(EV.roc_auc(_scores(spark, sf), "y", "score"), 9)


_CURVE_SQL = f"""WITH s AS ({_SCORE_SQL}),
g AS (SELECT score, SUM(y) AS pos, SUM(1 - y) AS neg FROM s GROUP BY score),
c AS (SELECT score, SUM(pos) OVER (ORDER BY score DESC) AS tps, SUM(neg) OVER (ORDER BY score DESC) AS fps,
             ROW_NUMBER() OVER (ORDER BY score DESC) AS rn FROM g),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM g)"""


@register("roc_points", _CURVE_SQL + """,
b AS (SELECT *, LAG(fps) OVER (ORDER BY rn) AS pf, LEAD(fps) OVER (ORDER BY rn) AS nf,
             LAG(tps) OVER (ORDER BY rn) AS pt, LEAD(tps) OVER (ORDER BY rn) AS nt FROM c)
SELECT score AS threshold, ROUND(COALESCE(fps * 1.0 / NULLIF(N, 0), 0.0), 9) AS fpr,
  ROUND(COALESCE(tps * 1.0 / NULLIF(P, 0), 0.0), 9) AS tpr
FROM b, t WHERE pf IS NULL OR nf IS NULL OR pf - 2 * fps + nf <> 0 OR pt - 2 * tps + nt <> 0
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_points(spark, sf):
    return round_doubles(EV.roc_points(_scores(spark, sf), "y", "score"), 9, {"threshold": None})


@register("pr_points", _CURVE_SQL + """
SELECT score AS threshold, ROUND(CASE WHEN P = 0 THEN 1.0 ELSE tps * 1.0 / P END, 9) AS recall,
       ROUND(COALESCE(tps * 1.0 / NULLIF(tps + fps, 0), 0.0), 9) AS precision FROM c, t
UNION ALL SELECT NULL, 0.0, 1.0""")
def pr_points(spark, sf):
    return round_doubles(EV.pr_points(_scores(spark, sf), "y", "score"), 9, {"threshold": None})


_REG_SQL = "SELECT l_extendedprice AS actual, 1500.0 * l_quantity AS predicted FROM lineitem"


def _reg_preds(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("actual"),
                                               (F.lit(1500.0) * F.col("l_quantity")).alias("predicted"))


_REG_METRICS_SQL = f"""WITH p AS ({_REG_SQL}),
m AS (SELECT AVG(ABS(actual - predicted)) AS MAE, AVG((actual - predicted) * (actual - predicted)) AS MSE,
             1 - SUM((actual - predicted) * (actual - predicted)) / (VAR_POP(actual) * COUNT(*)) AS R2 FROM p)"""


@register("regression_metrics", _REG_METRICS_SQL + """
SELECT ROUND(MAE, 6) AS MAE, ROUND(MSE, 4) AS MSE, ROUND(SQRT(MSE), 6) AS RMSE, ROUND(R2, 9) AS R2 FROM m""")
def regression_metrics(spark, sf):
    return round_doubles(EV.regression_metrics(_reg_preds(spark, sf), "actual", "predicted"), 6,
                         {"MSE": 4, "R2": 9})


@register("metrics_table", _REG_METRICS_SQL + """
SELECT 'MAE' AS Metric, ROUND(MAE, 6) AS Value FROM m UNION ALL SELECT 'MSE', ROUND(MSE, 4) FROM m
UNION ALL SELECT 'RMSE', ROUND(SQRT(MSE), 6) FROM m UNION ALL SELECT 'R2', ROUND(R2, 9) FROM m""")
def metrics_table(spark, sf):
    m = round_doubles(EV.regression_metrics(_reg_preds(spark, sf), "actual", "predicted"), 6,
                      {"MSE": 4, "R2": 9})
    return _metrics_table(m)


@register("residuals", f"""
SELECT predicted, actual - predicted AS residual FROM ({_REG_SQL})""")
def residuals(spark, sf):
    return EV.residuals(_reg_preds(spark, sf), "actual", "predicted")


_MD5 = "md5(CAST(o_orderkey AS VARCHAR) || ':42')"


@register("train_test_split", f"""
SELECT o_orderkey, o_orderstatus, {_MD5} < '33333333' AS is_test,
  ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5})
    <= ROUND(COUNT(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test_exact
FROM orders""")
def train_test_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    h = SP.hash_split(o, "o_orderkey")
    return SP.stratified_split(h, "o_orderstatus", "o_orderkey", flag="is_test_exact")


@register("cross_validate", f"""
SELECT o_orderkey, o_orderstatus,
  CAST(FLOOR(CAST(('0x' || substr({_MD5}, 1, 8)) AS BIGINT) * 5 / 4294967296.0) AS INTEGER) AS fold,
  CAST((rk > ROUND(n * 0.2)) AS INTEGER) + CAST((rk > ROUND(n * 0.4)) AS INTEGER)
    + CAST((rk > ROUND(n * 0.6)) AS INTEGER) + CAST((rk > ROUND(n * 0.8)) AS INTEGER) AS strat_fold
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5}) AS rk,
        COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""")
def cross_validate(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    o = o.withColumn("fold", SP.hash_fold("o_orderkey", 5))
    s = SP.stratified_split(o, "o_orderstatus", "o_orderkey", flag="__t", k_folds=5, fold_col="strat_fold")
    return s.drop("__t")
