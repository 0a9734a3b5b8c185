"""Evaluation metrics as DataFrame aggregations.

Classification metrics derive from the confusion counts (one group-by, k²
rows); ROC AUC and the ROC / PR curves come from scores grouped by value and
global running sums (``running_sums``), never from a window over raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import col
from strata.operators.ordered import neighbours, running_sums


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for the pairs that occur; labels are compared as strings."""
    return df.groupBy(col(actual).cast("string").alias("actual"), col(predicted).cast("string").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for every pair of labels, zeros included; labels
    are compared as strings.  The zeros are added by the cluster from the list of
    labels, which is as long as the model has classes."""
    counts = confusion_counts(df, actual, predicted)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("l")).agg(F.collect_set("l").alias("ls"))
    zeros = labels.select(F.explode("ls").alias("actual"), "ls").select(
        "actual", F.explode("ls").alias("predicted"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(zeros).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def per_class(cm: DataFrame) -> DataFrame:
    """(label, tp, predicted_n, support, precision, recall, f1) from confusion counts."""
    same = F.col("actual") == F.col("predicted")
    sides = cm.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted_n"), F.col("n").alias("support")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.col("n").alias("predicted_n"), F.lit(0).cast("long").alias("support")))).alias("s")).select("s.*")
    j = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted_n", "support")])
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted_n").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, F.nullif(p + r, F.lit(0.0))), F.lit(0.0))
    return j.select("label", "tp", "predicted_n", "support", p.alias("precision"), r.alias("recall"),
                    f1.alias("f1"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1 (zero
    division → 0)."""
    pc = per_class(confusion_counts(df, actual, predicted))
    n = F.sum("support").cast("double")
    return pc.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"))


def classification_report(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    """(label, precision, recall, f1_score, support): one row per class, then
    'accuracy' (accuracy in every column), 'macro avg', 'weighted avg'; rounded."""
    pc = per_class(confusion_counts(df, actual, predicted))
    rows = pc.select("label", "precision", "recall", F.col("f1").alias("f1_score"),
                     F.col("support").cast("double").alias("support"))
    n = F.sum("support").cast("double")
    acc = pc.agg((F.sum("tp") / n).alias("a")).select(
        F.lit("accuracy").alias("label"), F.col("a").alias("precision"), F.col("a").alias("recall"),
        F.col("a").alias("f1_score"), F.col("a").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1_score"),
                   n.alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_score"), n.alias("support"))
    out = reduce(DataFrame.unionByName, [rows, acc, macro, weighted])
    return out.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score", "support")])


# ---------------------------------------------------------------------------
# scores: AUC and curves
# ---------------------------------------------------------------------------

def _score_groups(df: DataFrame, actual: Column, score: Column, group: Column | None = None) -> DataFrame:
    keys = [score.cast("double").alias("score")]
    if group is not None:
        keys = [group.alias("grp")] + keys
    return df.groupBy(*keys).agg(F.count_if(actual).cast("long").alias("pos"),
                                 F.count_if(~actual).cast("long").alias("neg"))


def _auc_from_groups(g: DataFrame, by_group: bool) -> DataFrame:
    order = (["grp"] if by_group else []) + ["score"]
    rs = running_sums(g, order, ["neg", "pos"])
    if by_group:
        tot = g.groupBy("grp").agg(F.sum("neg").alias("N"), F.sum("pos").alias("P"))
        starts = running_sums(tot, ["grp"], ["N"], partitions=1, checkpoint=False).select(
            "grp", "N", "P", (F.col("cum_N") - F.col("N")).alias("start"))
        rs = rs.join(F.broadcast(starts), "grp")
        below = F.col("cum_neg") - F.col("neg") - F.col("start")
    else:
        below = F.col("cum_neg") - F.col("neg")
    contrib = F.col("pos") * (below + 0.5 * F.col("neg"))
    if by_group:
        return rs.groupBy("grp").agg(
            F.try_divide(F.sum(contrib), F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"))
    return rs.agg(F.try_divide(F.sum(contrib), F.sum("pos").cast("double") * F.sum("neg").cast("double"))
                  .alias("auc"))


def roc_auc(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """One row (roc_auc): binary AUC of ``score`` for class ``positive``, by the
    rank-sum over grouped scores (ties count one half)."""
    is_pos = col(actual) == F.lit(positive)
    return _auc_from_groups(_score_groups(df, is_pos, col(score)), False).select(F.col("auc").alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, actual: str, prob_cols: dict) -> DataFrame:
    """One row (roc_auc): macro mean of one-vs-rest AUCs; ``prob_cols`` maps a
    class value to its probability column.  All classes in one pass (long form)."""
    longs = [df.select(F.lit(str(k)).alias("grp"), (col(actual).cast("string") == F.lit(str(k))).alias("y"),
                       col(c).alias("s")) for k, c in prob_cols.items()]
    long = reduce(DataFrame.unionByName, longs)
    g = _score_groups(long, F.col("y"), F.col("s"), F.col("grp"))
    return _auc_from_groups(g, True).agg(F.avg("auc").alias("roc_auc"))


def _curve_base(df: DataFrame, actual: str, score: str, positive) -> DataFrame:
    g = _score_groups(df, col(actual) == F.lit(positive), col(score))
    # descending thresholds: order by the negated score
    g = g.withColumn("neg_score", -F.col("score"))
    return running_sums(g, ["neg_score"], ["pos", "neg"])


def roc_points(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """(threshold, fpr, tpr) from (inf, 0, 0) over descending distinct scores;
    collinear interior points are dropped as sklearn's ``drop_intermediate``."""
    rs = _curve_base(df, actual, score, positive)
    tot = rs.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = rs.select(F.col("_rank"), F.col("score").alias("threshold"),
                    F.col("cum_neg").cast("double").alias("fps"), F.col("cum_pos").cast("double").alias("tps"))
    # interior collinear points go first, then the origin is put in front: the highest threshold stays
    nb = neighbours(pts, "_rank", ["fps", "tps"])
    d2f = F.col("prev_fps") - 2 * F.col("fps") + F.col("next_fps")
    d2t = F.col("prev_tps") - 2 * F.col("tps") + F.col("next_tps")
    keep = F.col("prev_fps").isNull() | F.col("next_fps").isNull() | (d2f != 0) | (d2t != 0)
    origin = df.sparkSession.createDataFrame([(0, float("inf"), 0.0, 0.0)],
                                             "_rank long, threshold double, fps double, tps double")
    kept = nb.filter(keep).select(*origin.columns).unionByName(origin)
    # totals enter as a one-row aggregate joined by a constant key (1 row)
    tot = tot.select(F.lit(1).alias("__k"), "P", "N")
    return (kept.withColumn("__k", F.lit(1)).join(F.broadcast(tot), "__k")
            .select("threshold", F.coalesce(F.try_divide(F.col("fps"), F.col("N").cast("double")), F.lit(0.0)).alias("fpr"),
                    F.coalesce(F.try_divide(F.col("tps"), F.col("P").cast("double")), F.lit(0.0)).alias("tpr")))


def pr_points(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """(threshold, recall, precision) per distinct score plus the end point
    (recall 0, precision 1, threshold NULL)."""
    rs = _curve_base(df, actual, score, positive)
    tot = rs.agg(F.sum("pos").alias("P")).select(F.lit(1).alias("__k"), "P")
    j = rs.withColumn("__k", F.lit(1)).join(F.broadcast(tot), "__k")
    prec = F.coalesce(F.try_divide(F.col("cum_pos").cast("double"),
                                   (F.col("cum_pos") + F.col("cum_neg")).cast("double")), F.lit(0.0))
    rec = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / F.col("P").cast("double"))
    pts = j.select(F.col("score").alias("threshold"), rec.alias("recall"), prec.alias("precision"))
    end = df.sparkSession.createDataFrame([(None, 0.0, 1.0)], "threshold double, recall double, precision double")
    return pts.unionByName(end)


# ---------------------------------------------------------------------------
# regression
# ---------------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: MAE, MSE, RMSE, R2 (1 − SS_res / SS_tot) over the rows with both
    values; a constant actual gives R2 1 for a perfect fit and else 0."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    both = y.isNotNull() & p.isNotNull()
    y = F.when(both, y)
    e = y - p
    r2 = F.when(F.col("__v") > 0, 1.0 - F.try_divide(F.col("__ssr"), F.col("__v") * F.col("__n"))).when(
        F.col("__n") > 0, F.when(F.col("__ssr") == 0, 1.0).otherwise(0.0))
    return df.agg(F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"),
                  F.sum(e * e).alias("__ssr"), F.var_pop(y).alias("__v"), F.count(y).alias("__n")
                  ).select("MAE", "MSE", F.sqrt("MSE").alias("RMSE"), r2.alias("R2"))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(predicted, residual = actual − predicted)."""
    p = col(predicted).cast("double")
    return df.select(p.alias("predicted"), (col(actual).cast("double") - p).alias("residual"))


def prediction_plot(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted) points and the ideal-line end points (min, max over both)."""
    pts = df.select(col(actual).cast("double").alias("actual"), col(predicted).cast("double").alias("predicted"),
                    F.lit("point").alias("kind"))
    ends = df.agg(F.least(F.min(col(actual)), F.min(col(predicted))).cast("double").alias("lo"),
                  F.greatest(F.max(col(actual)), F.max(col(predicted))).cast("double").alias("hi"))
    line = ends.select(F.inline(F.array(F.struct(F.col("lo").alias("actual"), F.col("lo").alias("predicted")),
                                        F.struct(F.col("hi").alias("actual"), F.col("hi").alias("predicted"))))) \
        .withColumn("kind", F.lit("ideal"))
    return pts.unionByName(line)
