import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strata.operators import hinge as H
from strata.operators import models as M


def clouds(spark, classes=5, n=600):
    """Overlapping clouds of points; the third feature is constant, the fourth has a scale of its own."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in (*rng.normal([np.cos(i % classes), np.sin(i % classes)], 0.5), 3.0, 50 + 9 * rng.normal())],
             float(i % classes)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(3) \
        .withColumn("features", array_to_vector("x")).drop("x")


def test_machines_are_those_of_one_vs_rest(spark):
    d = clouds(spark, 4).cache()
    made = H.fit_machines(d, "features", "label", 4, 1 / 600, 25)
    svc = C.LinearSVC(regParam=1 / 600, maxIter=25, standardization=False)
    spark_ml = C.OneVsRest(classifier=svc, parallelism=4).fit(d)
    for c, m in enumerate(spark_ml.models):
        assert made.weights[c] == pytest.approx(m.coefficients.toArray(), rel=1e-6, abs=1e-9)
        assert made.intercepts[c] == pytest.approx(m.intercept, rel=1e-6)

    def rows(model):
        return [(r["p"], *r["m"]) for r in model.transform(d).orderBy("id").select(
            F.col("prediction").alias("p"), vector_to_array("rawPrediction").alias("m")).collect()]
    assert np.array(rows(made)) == pytest.approx(np.array(rows(spark_ml)), rel=1e-6, abs=1e-8)


def test_classes_share_their_passes(spark, tmp_path):
    """Five classes ask for no more jobs than the longest search does."""
    sc, d = spark.sparkContext, clouds(spark).cache()
    d.count()
    sc.setJobGroup("five", "five classes")
    try:
        fitted = M.LinearSVCLearner(max_iter=20).fit(d)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    platt = fitted.platt.summary.totalIterations if fitted.platt.hasSummary else 100
    assert len(sc.statusTracker().getJobIdsForGroup("five")) < 60 + 2 * platt
    M.save_fitted(spark, fitted, f"{tmp_path}/m")
    out = fitted.transform(d).select("id", "prediction", vector_to_array("probability").alias("p"))
    again = M.load_fitted(spark, f"{tmp_path}/m").transform(d).select("id", "prediction", vector_to_array("probability").alias("p"))
    assert again.exceptAll(out).isEmpty()


def test_a_class_without_rows_and_too_many_coefficients(spark, monkeypatch):
    d = clouds(spark, 3, 60).where("label <> 1")
    fitted = M.LinearSVCLearner(max_iter=10).fit(d)
    assert {r[0] for r in fitted.transform(d).select("prediction").distinct().collect()} <= {0.0, 2.0}
    monkeypatch.setattr(H, "MOST_COEFFICIENTS", 14)
    assert H.fit_machines(d, "features", "label", 3, 0.1) is None


def test_features_must_be_finite(spark):
    d = clouds(spark, 3, 30).withColumn("features", array_to_vector(F.array(F.lit(float("inf")), F.col("label"))))
    with pytest.raises(Exception, match="infinite"):
        H.fit_machines(d, "features", "label", 3, 0.1)
