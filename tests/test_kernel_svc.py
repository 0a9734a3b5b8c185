import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strata.operators import kernel as KE
from strata.operators import models as M


def rings(spark, n=600):
    """Two classes: a disc and the ring around it (no line parts them)."""
    rng = np.random.default_rng(4)
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 2 == 0, rng.uniform(0, 1, n), rng.uniform(1.5, 2.5, n))
    rows = [(i, [float(r * np.cos(a)), float(r * np.sin(a))], float(i % 2)) for i, (a, r) in enumerate(zip(angle, radius))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("features", array_to_vector("x")).drop("x")


def accuracy(fitted, d):
    return fitted.transform(d).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_the_radial_kernel_parts_rings(spark, tmp_path):
    d = rings(spark).cache()
    train, test = d.where("id % 5 > 0"), d.where("id % 5 = 0")
    fitted = M.SVCLearner(landmarks=60).fit(train)
    assert accuracy(fitted, test) > 0.97
    assert accuracy(M.SVCLearner(kernel="linear").fit(train), test) < 0.75
    out = fitted.transform(test)
    assert out.columns == ["id", "label", "features", "probability", "prediction"] or set(out.columns) == {
        "id", "label", "features", "probability", "prediction"}
    for r in out.select("label", vector_to_array("probability").alias("p")).collect():
        assert sum(r["p"]) == pytest.approx(1)
    M.save_fitted(spark, fitted, f"{tmp_path}/m")
    again = M.load_fitted(spark, f"{tmp_path}/m").transform(test).select("id", "prediction")
    assert again.exceptAll(out.select("id", "prediction")).isEmpty()


def test_three_classes(spark):
    d = rings(spark, 450).withColumn("label", F.when((F.col("label") == 1) & (vector_to_array("features")[0] > 0), 2.0)
                                     .otherwise(F.col("label")))
    assert accuracy(M.SVCLearner(landmarks=80).fit(d), d) > 0.93


def test_features_equal_the_kernel_at_the_landmarks(spark):
    d = rings(spark, 40)
    made = KE.fit_kernel_map(d, "features", gamma=0.7, landmarks=25)
    z = made.landmarks
    assert z.shape == (25, 2) and len({tuple(r) for r in z}) == 25
    phi = made.apply(z)
    exact = np.exp(-0.7 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert np.abs(phi @ phi.T - exact).max() < 1e-6
    got = {r["id"]: r["k"] for r in made.transform(d, "features", "f").select("id", vector_to_array("f").alias("k")).collect()}
    x = {r["id"]: r["x"] for r in d.select("id", vector_to_array("features").alias("x")).collect()}
    for i, v in got.items():
        assert v == pytest.approx(made.apply(np.array([x[i]]))[0], abs=1e-9)


def test_gamma_scale_and_arguments(spark):
    d = rings(spark, 100)
    x = np.array([r["x"] for r in d.select(vector_to_array("features").alias("x")).collect()])
    assert KE.scale_gamma(d, "features") == pytest.approx(1 / (2 * x.var()))
    same = d.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(1.0))))
    assert KE.scale_gamma(same, "features") == 1.0
    assert KE.draw_landmarks(same, "features").shape == (1, 2)
    with pytest.raises(ValueError):
        M.SVCLearner(kernel="poly")
    with pytest.raises(ValueError):
        KE.fit_kernel_map(d, "features", gamma=-1)
