import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strata.operators import models as M


@pytest.fixture(scope="module")
def points(spark):
    d = spark.range(600).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"),
                                (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("y"))
    return d.withColumn("features", array_to_vector(F.array("x", "y"))).withColumn("label", F.floor(F.col("x") * 3).cast("double")).cache()


def test_classifier_groups_vote_as_one_forest(spark, points, tmp_path):
    fitted = M.forest_classifier(num_trees=23, group=10).fit(points)
    assert [m.getNumTrees for m in fitted.models] == [10, 10, 3]
    out = fitted.transform(points)
    assert out.columns == [*points.columns, "rawPrediction", "probability", "prediction"]
    assert out.where("prediction <> label").count() < 12
    votes = [{r["id"]: r["v"] for r in m.transform(points).select("id", vector_to_array("rawPrediction").alias("v")).collect()}
             for m in fitted.models]
    for r in out.select("id", "prediction", vector_to_array("probability").alias("p"),
                        vector_to_array("rawPrediction").alias("v")).collect():
        want = [sum(x) for x in zip(*(v[r["id"]] for v in votes))]
        assert r["v"] == pytest.approx(want) and sum(want) == pytest.approx(23)
        assert r["p"] == pytest.approx([w / 23 for w in want]) and r["prediction"] == want.index(max(want))
    x, y = fitted.feature_importances
    assert x > 0.8 and x + y == pytest.approx(1)
    M.save_fitted(spark, fitted, f"{tmp_path}/m")
    again = M.load_fitted(spark, f"{tmp_path}/m").transform(points)
    assert again.select("id", "prediction").exceptAll(out.select("id", "prediction")).isEmpty()


def test_regressor_averages_by_trees(spark, points, tmp_path):
    d = points.withColumn("label", F.col("x") * 10 + F.col("y"))
    fitted = M.forest_regressor(num_trees=12, group=5).fit(d)
    assert [m.getNumTrees for m in fitted.models] == [5, 5, 2]
    out = fitted.transform(d).select("id", "label", "prediction")
    single = [{r["id"]: r["prediction"] for r in m.transform(d).select("id", "prediction").collect()} for m in fitted.models]
    for r in out.collect():
        a, b, c = (s[r["id"]] for s in single)
        assert r["prediction"] == pytest.approx((5 * a + 5 * b + 2 * c) / 12)
    assert out.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 0.5
    M.save_fitted(spark, fitted, f"{tmp_path}/m")
    again = M.load_fitted(spark, f"{tmp_path}/m").transform(d).select("id", "label", "prediction")
    assert again.exceptAll(out).isEmpty()
