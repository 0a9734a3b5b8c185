import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from strata.operators import models as M
from strata.plans import train as TR


def test_registry():
    cls = M.available_models("classification")
    assert "Random Forest" in cls and cls == sorted(cls)
    assert "Linear Regression" in M.available_models("regression")
    with pytest.raises(ValueError):
        M.create_model("Nope", "classification")
    with pytest.raises(ValueError):
        M.available_models("time_series")
    assert M.model_supports_probability("K-Nearest Neighbours", "classification")
    assert M.model_supports_feature_importance("Random Forest Regressor", "regression")


def _reg_data(spark, n=200):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = 2.0 * x[:, 0] - 3.0 * x[:, 1] + 0.5 * x[:, 2] + 1.0 + rng.normal(scale=0.1, size=n)
    rows = [(i, float(a), float(b), float(c), float(t)) for i, (a, b, c), t in zip(range(n), x, y)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), x, y


def test_linear_recovers_coefficients(spark):
    df, _, _ = _reg_data(spark)
    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.withColumnRenamed("y", "label"))
    m = M.create_model("Linear Regression", "regression").fit(d).model
    assert np.allclose(m.coefficients.toArray(), [2.0, -3.0, 0.5], atol=0.05)


def test_ridge_matches_closed_form(spark):
    df, x, y = _reg_data(spark)
    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.withColumnRenamed("y", "label"))
    m = M.create_model("Ridge Regression", "regression", alpha=10.0).fit(d).model
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(3), xc.T @ yc)  # scikit-learn Ridge objective
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-3)


def _cls_data(spark, n=300):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2))
    lab = np.where(x[:, 0] + x[:, 1] > 0, "yes", "no")
    return spark.createDataFrame([(i, float(a), float(b), str(l)) for i, (a, b), l in zip(range(n), x, lab)],
                                 "id long, a double, b double, target string")


@pytest.mark.parametrize("name", ["Logistic Regression", "Random Forest", "Decision Tree", "Naive Bayes",
                                  "K-Nearest Neighbours"])
def test_classifiers_accuracy_floor(spark, name):
    df = _cls_data(spark)
    over = {"num_trees": 10} if name == "Random Forest" else {}
    res = TR.train_model(df, "target", name, "classification", ["a", "b"], "id",
                         TR.TrainConfig(cross_validation=False), overrides=over)
    acc = TR.evaluate_model(res)["metrics"].first()["accuracy"]
    assert acc >= 0.5


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    tr = rng.normal(size=(60, 4))
    te = rng.normal(size=(7, 4))
    lab = rng.integers(0, 3, size=60)
    from strata.operators.knn import fit_knn
    train = spark.createDataFrame([(i, [float(v) for v in r], int(l)) for i, (r, l) in enumerate(zip(tr, lab))],
                                  "id long, x array<double>, y int")
    test = spark.createDataFrame([(100 + i, [float(v) for v in r]) for i, r in enumerate(te)], "qid long, x array<double>")
    model = fit_knn(train, "x", "y", "id", k=5)
    got = {r["qid"]: r["predicted_label"] for r in model.transform(test).collect()}
    for i, q in enumerate(te):
        d = ((tr - q) ** 2).sum(axis=1)
        nn = np.lexsort((np.arange(60), d))[:5]
        votes = np.bincount(lab[nn], minlength=3)
        assert got[100 + i] == int(votes.argmax())


def test_predict_with_missing_feature_and_importance(spark):
    df = _cls_data(spark)
    res = TR.train_model(df, "target", "Random Forest", "classification", ["a", "b"], "id",
                         TR.TrainConfig(cross_validation=False), overrides={"num_trees": 5})
    score = spark.createDataFrame([(1, 0.3), (2, -0.5)], "id long, a double")
    out = TR.predict(res, score)
    assert out.columns == ["id", "a", "Prediction", "Probability_Class_0", "Probability_Class_1"]
    assert out.count() == 2
    imp = TR.feature_importance(res)
    assert imp.count() == 2


def test_cross_validation_summary(spark):
    df = _cls_data(spark, 150)
    res = TR.train_model(df, "target", "Logistic Regression", "classification", ["a", "b"], "id",
                         TR.TrainConfig(cv_folds=3))
    assert res.cross_validation.count() == 3
    summ = {r["Metric"]: r for r in TR.cross_validation_summary(res.cross_validation).collect()}
    assert summ["test_score"]["Mean"] >= 0.5


def test_score_stream(spark, tmp_path):
    from strata.streaming import score_stream
    df = _cls_data(spark, 120)
    res = TR.train_model(df, "target", "Logistic Regression", "classification", ["a", "b"], "id",
                         TR.TrainConfig(cross_validation=False))
    src = tmp_path / "in"
    df.select("id", "a", "b").write.parquet(str(src))
    stream = spark.readStream.schema("id long, a double, b double").parquet(str(src))
    q = score_stream(res, stream).writeStream.format("memory").queryName("scored_stream").start()
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM scored_stream")
    assert out.count() == 120 and "Prediction" in out.columns


@pytest.mark.parametrize("name,problem", [(n, p) for p in ("classification", "regression") for n in M.available_models(p)])
def test_every_model_is_saved_and_loaded(spark, tmp_path, name, problem):
    import random
    rng = random.Random(1)
    data = [(i, rng.random(), rng.random(), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame([(i, x, y, c, ("no" if x + y < 1 else "yes"), 3 * x - y) for i, x, y, c in data],
                               "id long, x double, y double, c string, cls string, num double").coalesce(1)
    target = "cls" if problem == "classification" else "num"
    small = {"num_trees": 5} if "Forest" in name else {"max_iter": 5} if "Boosting" in name or "Perceptron" in name \
        else {"n_estimators": 4} if "AdaBoost" in name else {}
    feats = ["x", "y"] if name in ("Naive Bayes",) else ["x", "y", "c"]
    res = TR.train_model(df, target, name, problem, feats, "id", TR.TrainConfig(cross_validation=False), overrides=small)
    loaded = TR.load_result(spark, TR.save_result(res, f"file://{tmp_path}/m"))
    one, two = (sorted(map(str, TR.predict(r, df).collect())) for r in (res, loaded))
    assert one == two


def test_evaluation_uses_the_users_labels(spark):
    df = spark.createDataFrame([(i, float(i % 7), "FOP"[i % 3] if i % 7 < 6 else "P") for i in range(210)],
                               "id long, x double, y string")
    res = TR.train_model(df, "y", "Decision Tree", "classification", ["x"], "id", TR.TrainConfig(cross_validation=False))
    ev = TR.evaluate_model(res, repeats=2)
    assert {r["actual"] for r in ev["confusion_matrix"].collect()} == {"F", "O", "P"}
    assert "roc_auc" in ev["metrics"].columns and ev["metrics"].count() == 1
    assert {r["feature"] for r in ev["permutation_importance"].collect()} == {"x"} and ev["problems"] == {}


def test_tuning_finds_the_known_best_and_keeps_overrides(spark):
    df = spark.createDataFrame([(i, float(i % 16), (i % 16) // 2 % 2) for i in range(480)], "id long, x double, y int")
    cfg = TR.TrainConfig(cross_validation=False, hyperparameter_tuning=True, cv_folds=3, scoring="f1")
    res = TR.train_model(df, "y", "Decision Tree", "classification", ["x"], "id", cfg, grid={"max_depth": [1, 6]},
                         overrides={"seed": 7})
    assert res.best_parameters == {"max_depth": 6}


def test_stratified_split_matches_ranks(spark):
    import hashlib
    from strata.operators.split import stratified_split
    rows_ = [(i, "ab"[i % 5 == 0]) for i in range(500)] + [(1000 + i, None) for i in range(7)]
    out = stratified_split(spark.createDataFrame(rows_, "id long, y string"), "y", "id", 0.2, k_folds=4).collect()
    assert len(out) == len(rows_)
    for lab in ("a", "b", None):
        ids = sorted((i for i, y in rows_ if y == lab), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        n = len(ids)
        got = {r["id"]: (r["is_test"], r["fold"]) for r in out if r["y"] == lab}
        cut = [int(n * 0.2 + 0.5)] + [int(n * f / 4 + 0.5) for f in (1, 2, 3)]
        for k, i in enumerate(ids, 1):
            assert got[i] == (k <= cut[0], sum(k > c for c in cut[1:])), (lab, i)


def test_knn_tiles_and_ties(spark, monkeypatch):
    import numpy as np
    from strata.operators import knn as K
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (300, 3)).astype(float)
    best = K._Best(len(x), 5)
    monkeypatch.setattr(K, "QUERY_ROWS", 7)
    ids, ys = np.arange(300)[::-1].copy(), rng.random(300)
    for at in range(0, 300, 23):
        best.add(x, x[at:at + 23], ids[at:at + 23], ys[at:at + 23])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for q in range(300):
        order = np.lexsort((ids, d[q]))[:5]
        assert (best.i[q] == ids[order]).all() and np.allclose(best.d[q], d[q][order]) and (best.y[q] == ys[order]).all()


def test_folds_are_kept_in_partitions_that_grow_with_their_rows(spark, monkeypatch):
    from strata.plans import train as TR
    df = spark.range(1000).withColumnRenamed("id", "n").repartition(40)
    kept, folded = TR.kept_folds(df)
    try:
        assert folded.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 40
        assert sorted(r["n"] for r in folded.collect()) == list(range(1000))
        assert kept.storageLevel.useMemory
    finally:
        kept.unpersist()
    monkeypatch.setattr(TR, "FOLD_ROWS", 50)
    kept, folded = TR.kept_folds(df)
    assert folded.rdd.getNumPartitions() == 20
    kept.unpersist()
