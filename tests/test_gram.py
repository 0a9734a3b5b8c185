import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strata.operators import gram as G

CANDIDATES = [{"model": "linear"}, {"model": "ridge", "alpha": 3.0}, {"model": "lasso", "alpha": 0.4},
              {"model": "elastic_net", "alpha": 0.5, "l1_ratio": 0.3}, {"model": "lasso", "alpha": 1e6}]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.5, 2, 1] + [1000, 0, -5, 1e5, 0]
    x[:, 4] = x[:, 1] * 0.9 + x[:, 4] * 0.1
    y = 2 * x[:, 0] - x[:, 1] + 0.01 * x[:, 3] + rng.normal(size=400)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, x array<double>, y double")
    return df.cache(), x, y


def objective(w, x, y, model, alpha=1.0, l1_ratio=0.5):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    error = ((yc - xc @ w) ** 2).sum()
    if model in ("linear", "ridge"):
        return error + (alpha * (w ** 2).sum() if model == "ridge" else 0)
    ratio = 1.0 if model == "lasso" else l1_ratio
    return error / (2 * len(y)) + alpha * (ratio * np.abs(w).sum() + (1 - ratio) * (w ** 2).sum() / 2)


@pytest.mark.parametrize("candidate", CANDIDATES)
def test_solutions_are_minima(data, candidate):
    df, x, y = data
    w, b = G.fit_linear_sums(df, "x", "y", **candidate)
    at = objective(w, x, y, **candidate)
    rng = np.random.default_rng(2)
    for size in (1e-2, 1e-3, 1e-4):
        for _ in range(60):
            assert objective(w + rng.normal(size=5) * size, x, y, **candidate) >= at - 1e-9 * abs(at)
    assert b == pytest.approx(y.mean() - x.mean(axis=0) @ w, abs=1e-6)
    if candidate["model"] in ("linear", "ridge"):
        xc, yc = x - x.mean(axis=0), y - y.mean()
        exact = np.linalg.solve(xc.T @ xc + candidate.get("alpha", 0.0) * np.eye(5), xc.T @ yc)
        assert w == pytest.approx(exact, rel=1e-6, abs=1e-8)
    if candidate.get("alpha") == 1e6:
        assert (w == 0).all()


def test_folds_equal_fits_on_their_rows(data):
    df, x, y = data
    fold = np.arange(400) % 4
    got = G.cross_validate_linear(df.repartition(5), "x", "y", F.col("id") % 4, CANDIDATES).collect()
    assert len(got) == 4 * len(CANDIDATES) and all(r["rows"] == 100 for r in got)
    for r in got:
        tr, te = fold != r["fold"], fold == r["fold"]
        z = np.concatenate([np.ones((tr.sum(), 1)), x[tr], y[tr, None]], axis=1)
        z[:, 1:] -= [*x[0], y[0]]
        w, _ = G.solve(z.T @ z, **CANDIDATES[r["candidate"]])
        error = y[te] - (y[tr].mean() + (x[te] - x[tr].mean(axis=0)) @ w)
        assert r["mse"] == pytest.approx((error ** 2).mean(), rel=1e-6)
        assert r["r2"] == pytest.approx(1 - (error ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum(), abs=1e-6)
    best = G.best_linear(G.cross_validate_linear(df, "x", "y", F.col("id") % 4, CANDIDATES)).first()
    assert best["candidate"] in (0, 1)


def test_one_job_scans_the_rows(spark, data):
    """The number of candidates does not change what Spark runs."""
    df, _, _ = data
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for many in (1, 40):
        spark.sparkContext.setJobGroup(f"gram{many}", "")
        G.cross_validate_linear(df, "x", "y", F.col("id") % 4, [{"model": "ridge", "alpha": float(a)} for a in range(many)])
        jobs.append(len(tracker.getJobIdsForGroup(f"gram{many}")))
    assert jobs[0] == jobs[1]


def test_nulls_vectors_and_empty_tables(spark, data):
    df, x, y = data
    odd = df.unionByName(spark.createDataFrame([(400, None, 1.0), (401, [1.0] * 5, None), (402, [None] + [1.0] * 4, 2.0),
                                                (403, [float("nan")] * 5, 3.0)], df.schema))
    assert G.fit_linear_sums(odd, "x", "y")[0] == pytest.approx(G.fit_linear_sums(df, "x", "y")[0])
    vec = df.withColumn("x", array_to_vector("x"))
    assert G.fit_linear_sums(vec, "x", "y", model="ridge")[0] == pytest.approx(G.fit_linear_sums(df, "x", "y", model="ridge")[0])
    none = df.limit(0)
    assert G.cross_validate_linear(none, "x", "y", F.lit(0), CANDIDATES).count() == 0
    assert G.cross_validate_linear(df, "x", "y", F.lit(0), CANDIDATES).count() == 0  # no training rows
    with pytest.raises(ValueError):
        G.fit_linear_sums(none, "x", "y")
    with pytest.raises(ValueError):
        G.cross_validate_linear(df, "x", "y", F.lit(0), [{"model": "tree"}])
