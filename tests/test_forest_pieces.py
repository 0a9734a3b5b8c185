"""Forests whose trees grow where the rows of a node meet, against Spark's."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strata.operators import forest as P
from strata.operators import models as M


@pytest.fixture(scope="module")
def points(spark):
    """2,400 rows of three classes by two of five features, one in ten with another's label."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2400, 5))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    y = np.where(rng.random(2400) < 0.1, rng.integers(0, 3, 2400), y)
    return spark.createDataFrame([(i, v.tolist(), float(k)) for i, (v, k) in enumerate(zip(x, y))],
                                 "id long, x array<double>, label double").repartition(3).withColumn(
        "features", array_to_vector("x")).drop("x").cache()


def share(out):
    return out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("whole", [100_000, 300])
def test_as_good_as_spark_forest_with_and_without_split_tops(spark, points, tmp_path, whole):
    train, test = points.where("id % 4 > 0"), points.where("id % 4 = 0")
    fitted = P.fit_forest(train, "features", "label", 40, 30, 42, from_rows=1, whole=whole)
    assert (len(fitted.top.tree) > 40) == (whole == 300)
    out = fitted.transform(test)
    assert out.columns == [*test.columns, "rawPrediction", "probability", "prediction"]
    plain = C.RandomForestClassifier(numTrees=40, maxDepth=30, seed=42, featureSubsetStrategy="sqrt").fit(train)
    assert share(out) == pytest.approx(share(plain.transform(test)), abs=0.03)
    assert share(fitted.transform(train)) > 0.95  # deep trees know nearly all of their rows
    assert fitted.feature_importances == pytest.approx(list(plain.featureImportances.toArray()), abs=0.05)
    for r in out.select("prediction", vector_to_array("rawPrediction").alias("v"), vector_to_array("probability").alias("p")).collect():
        assert sum(r["v"]) == pytest.approx(40) and r["p"] == pytest.approx([v / 40 for v in r["v"]])
        assert r["prediction"] == r["v"].index(max(r["v"]))
    M.save_fitted(spark, fitted, f"{tmp_path}/m")
    again = M.load_fitted(spark, f"{tmp_path}/m").transform(test).select("id", "prediction")
    assert again.exceptAll(out.select("id", "prediction")).isEmpty()


def test_every_drawn_row_reaches_one_leaf():
    """A tree over rows that all differ holds every row: its leaves tell each row's class, and split or not, all are counted."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 32, (5000, 6)).astype(np.uint8), rng.integers(0, 4, 5000)
    g = P.grow(x, y, 4, 6, 30, rng)
    end = P.walk(g.feature, g.upto, g.left, x, np.zeros(5000, np.int32))
    assert (g.feature[end] < 0).all()
    one = g.feature[end] == -1
    assert one.mean() > 0.99 and (g.left[end[one]] == y[one]).all()
    flat = P.grow(np.zeros((9, 2), np.uint8), np.array([0] * 5 + [1] * 4), 2, 2, 30, rng)
    assert flat.feature.tolist() == [-2] and flat.mixed.tolist() == [[5, 4]]


def test_the_split_of_a_node_has_the_largest_gain():
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 8, (400, 3)).astype(np.uint8), rng.integers(0, 3, 400)
    g = P.grow(x, y, 3, 3, 1, rng)
    total = np.bincount(y, minlength=3).astype(float)
    gains = {(f, b): P.gain_of(np.bincount(y[x[:, f] <= b], minlength=3).astype(float), total) for f in range(3) for b in range(8)}
    assert gains[(g.feature[0], g.upto[0])] == pytest.approx(max(gains.values()))
    assert g.gained.sum() == pytest.approx(max(gains.values()))


def test_rows_that_cannot_be_parted_are_a_leaf_above(spark):
    """A node beyond the bound that no feature splits stays one leaf; no task gets its rows."""
    d = spark.range(2000).select("id", array_to_vector(F.array(F.lit(1.0), (F.col("id") % 2).cast("double"))).alias("features"),
                                 F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0).alias("label"))
    fitted = P.fit_forest(d, "features", "label", 5, 30, 1, from_rows=1, whole=100)
    assert not (fitted.top.feature == -1).any() and spark.read.parquet(fitted.path).isEmpty()
    p = fitted.transform(d).agg(F.avg(vector_to_array("probability")[1])).first()[0]
    assert p == pytest.approx(0.2, abs=0.05)


def test_many_rows_take_this_way(spark, points, monkeypatch):
    monkeypatch.setattr(P, "FROM_ROWS", 1000)
    assert isinstance(M.forest_classifier(num_trees=3).fit(points), P.PieceForest)
    monkeypatch.setattr(P, "FROM_ROWS", 10_000)
    assert isinstance(M.forest_classifier(num_trees=3).fit(points), M.ForestFitted)
    with pytest.raises(ValueError):
        P._matrix(__import__("pyarrow").array([[1.0, float("nan")]]), 2)
