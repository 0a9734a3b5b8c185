"""Multinomial boosting against a plain numpy version, and saved and loaded again."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from strata.operators.boost import SoftmaxBoost
from strata.operators.models import GBTClassifierLearner, load_fitted, save_fitted


def _data(n=300, seed=3):
    """Three classes of which no line parts one from the others."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = np.where(np.abs(x[:, 0] - 6) < 2, 0, np.where(x[:, 1] + rng.normal(0, 1.5, n) > 6, 1, 2))
    return x, y


def _frame(spark, x, y):
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "id long, a array<double>, label double").repartition(3)
    return d.select("id", array_to_vector("a").alias("features"), "label")


def _tree(x, g, depth):
    """Best split by variance, recursively: rows -> leaf membership as a nested rule."""
    best, total = (1e-12, None, None), ((g - g.mean()) ** 2).sum()
    if depth:
        for f in range(x.shape[1]):
            for t in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2:
                left = x[:, f] <= t
                gain = total - sum(((p - p.mean()) ** 2).sum() for p in (g[left], g[~left]))
                if gain > best[0] + 1e-9:
                    best = (gain, f, t)
    if best[1] is None:
        a = np.abs(g)
        return ("leaf", g.sum() / (a * (1 - a)).sum())
    left = x[:, best[1]] <= best[2]
    return ("split", best[1], best[2], _tree(x[left], g[left], depth - 1), _tree(x[~left], g[~left], depth - 1))


def _apply(tree, x):
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    left, out = x[:, tree[1]] <= tree[2], np.empty(len(x))
    out[left], out[~left] = _apply(tree[3], x[left]), _apply(tree[4], x[~left])
    return out


def _softmax(f):
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _plain(x, y, k, rounds, step, depth):
    f = np.tile(np.log([(y == c).mean() for c in range(k)]), (len(x), 1))
    for _ in range(rounds):
        p = _softmax(f)
        for c in range(k):
            f[:, c] += step * (k - 1) / k * _apply(_tree(x, (y == c) - p[:, c], depth), x)
    return _softmax(f)


def _scores(model, d):
    got = model.transform(d).select("id", vector_to_array("probability").alias("p"), "prediction").orderBy("id").collect()
    return np.array([r["p"] for r in got]), np.array([r["prediction"] for r in got])


def test_equals_the_plain_version(spark):
    x, y = _data()
    d = _frame(spark, x, y)
    model = SoftmaxBoost(3, max_iter=5, step=0.3, max_depth=2, checkpoint_every=2).fit(d)
    p, prediction = _scores(model, d)
    want = _plain(x, y, 3, 5, 0.3, 2)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-12)
    assert np.allclose(p, want, atol=1e-6)
    assert (prediction == want.argmax(axis=1)).all()


def test_learner_saves_and_loads(spark, tmp_path):
    x, y = _data(400, 8)
    d = _frame(spark, x, y)
    fitted = GBTClassifierLearner(max_iter=12, step=0.4).fit(d)
    p, prediction = _scores(fitted, d)
    assert (prediction == y).mean() > 0.85
    assert abs(sum(fitted.feature_importances) - 1) < 1e-9 and fitted.feature_importances[2] < 0.2
    save_fitted(spark, fitted, str(tmp_path / "m"))
    again, _ = _scores(load_fitted(spark, str(tmp_path / "m")), d)
    assert np.array_equal(p, again)


def test_a_class_without_rows_and_an_empty_batch(spark):
    x, y = _data(60)
    y[y == 1] = 0  # class 1 of 3 has no rows
    d = _frame(spark, x, y)
    model = SoftmaxBoost(3, max_iter=2).fit(d)
    p, prediction = _scores(model, d)
    assert p[:, 1].max() < 1e-5 and set(prediction) <= {0.0, 2.0}
    assert model.transform(d.where(F.lit(False))).count() == 0
