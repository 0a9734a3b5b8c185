"""Trees on the cells of a grid against trees on the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strata.operators import grid as G
from strata.operators import models as M


@pytest.fixture(scope="module")
def points(spark):
    """2,000 rows of 8 x 6 x 5 cells, and labels that spread inside a cell."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, n, 2000) for n in (8, 6, 5)], axis=1).astype(float)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 2, 9, 0) + rng.normal(0, 2, 2000)
    rows = [(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "id long, a array<double>, label double").repartition(3)
    return d.select("id", array_to_vector("a").alias("features"), "label").cache()


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(G, "FROM_ROWS", 1)


def _predictions(fitted, d):
    out = fitted.transform(d).orderBy("id")
    return np.array([r["prediction"] for r in out.select("prediction").collect()])


def test_thresholds_are_halfway_or_at_equal_counts():
    assert G.thresholds(np.array([3.0, 1.0, 1.0, 2.0, np.nan])) == [1.5, 2.5]
    assert G.thresholds(np.array([7.0, 7.0])) == []
    ends = G.thresholds(np.arange(1000.0), 4)
    assert len(ends) == 3 and all(abs(e - w) <= 1 for e, w in zip(ends, (249.5, 499.5, 749.5)))


def test_bins_of_values_at_and_beyond_the_ends(spark):
    grid = G.Grid([[1.5, 2.5, 4.0], []])
    d = spark.createDataFrame([([v, 0.0],) for v in (1.5, 1.6, 2.5, 4.0, 4.1, float("nan"))], "a array<double>")
    got = grid.binned(d.select(array_to_vector("a").alias("features")), "features", "b").select("b", grid.cell("b").alias("c"))
    assert [(r["b"], r["c"]) for r in got.collect()] == [([b, 0], b) for b in (0, 1, 1, 2, 3, 3)]


def test_few_rows_or_many_cells_have_no_grid(spark, points):
    assert G.make_grid(points, "features", 1) is None
    assert G.make_grid(points, "features", 1, from_rows=2000).shape == (8, 6, 5)
    wide = points.select(array_to_vector(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.rand(3) + i)).alias("features"))
    assert G.make_grid(wide, "features", 1, from_rows=1) is None
    assert G.make_grid(points.limit(0), "features", 1, from_rows=0) is None


def test_boosted_regression_equals_that_of_the_rows(spark, points, always, tmp_path):
    fitted = M.gbt_regressor(max_iter=8).fit(points)
    assert isinstance(fitted, G.BinnedFitted)
    plain = R.GBTRegressor(maxIter=8, stepSize=0.1, maxDepth=3, seed=42).fit(points)
    got = _predictions(fitted, points)
    assert np.allclose(got, _predictions(plain, points), atol=1e-9)
    assert np.allclose(fitted.feature_importances, plain.featureImportances.toArray(), atol=1e-6)
    M.save_fitted(spark, fitted, f"{tmp_path}/m")
    assert np.array_equal(got, _predictions(M.load_fitted(spark, f"{tmp_path}/m"), points))


def test_multinomial_boosting_equals_that_of_the_rows(spark, points, monkeypatch):
    d = points.withColumn("label", F.when(F.col("label") > 18, 2.0).when(F.col("label") > 8, 1.0).otherwise(0.0)).cache()
    both = []
    for least in (1, 10 ** 9):
        monkeypatch.setattr(G, "FROM_ROWS", least)
        out = M.GBTClassifierLearner(max_iter=4).fit(d).transform(d).orderBy("id")
        both.append(np.array([r["p"] for r in out.select(vector_to_array("probability").alias("p")).collect()]))
    assert np.allclose(both[0], both[1], atol=1e-9)


def test_a_tree_equals_sparks(spark, points):
    grid = G.make_grid(points, "features", 1, from_rows=1)
    rows = grid.binned(points, "features", "b").select("id", grid.cell("b").alias("c"), "label").orderBy("id").toPandas()
    bins = grid.bins_of_cells()
    for depth in (2, 4, 30):
        n = np.bincount(rows.c, minlength=len(bins)).astype(float)
        value, gain = G.grow(bins, n, np.bincount(rows.c, rows.label, len(bins)), depth)
        plain = R.DecisionTreeRegressor(maxDepth=depth, seed=1).fit(points)
        assert np.allclose(value[rows.c], _predictions(plain, points), atol=1e-9)
        assert np.allclose(gain / gain.sum(), plain.featureImportances.toArray(), atol=1e-6)


def test_every_row_is_drawn_a_poisson_number_of_times(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("c"), F.col("id").cast("double").alias("y")).coalesce(1)
    got = G.forest_sums(rows, 2, 500, 7).collect()
    n = np.array([np.frombuffer(r["n"], float) for r in got])
    total = np.array([np.frombuffer(r["total"], float) for r in got])
    assert [r["tree"] for r in got] == list(range(500))
    assert np.allclose(n.mean(axis=0), 200, atol=3) and np.allclose(n.var(axis=0), 200, rtol=0.2)
    assert np.allclose(total.sum(axis=0) / n.sum(axis=0), [199, 200], atol=2)
    assert abs(np.corrcoef(n[:, 0], n[:, 1])[0, 1]) < 0.15


def test_forest_is_near_that_of_the_rows(spark, points, always, tmp_path):
    fitted = M.forest_regressor(num_trees=60).fit(points)
    assert isinstance(fitted, G.GridForest)
    plain = R.RandomForestRegressor(numTrees=60, maxDepth=30, featureSubsetStrategy="all", seed=1).fit(points)
    got, want = _predictions(fitted, points), _predictions(plain, points)
    assert np.abs(got - want).mean() < 0.25 and np.corrcoef(got, want)[0, 1] > 0.995
    assert np.allclose(fitted.feature_importances, plain.featureImportances.toArray(), atol=0.02)
    assert np.array_equal(got, _predictions(M.forest_regressor(num_trees=60).fit(points), points))
    M.save_fitted(spark, fitted, f"{tmp_path}/m")
    assert np.array_equal(got, _predictions(M.load_fitted(spark, f"{tmp_path}/m"), points))
