import math

from conftest import rows
from strata.operators import evaluate as EV
from strata.operators import split as SP
from strata.operators import target as TG


def test_keyword_score_additive():
    assert TG.keyword_score("quality") == 80.0  # 'quality' exact + contains 'y'
    assert TG.keyword_score("Sale Price") == 30.0


def test_problem_type(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, float(i) * 1.5) for i in range(50)], "k int, b boolean, y double")
    assert TG.detect_problem(df, "b").problem_type == "classification"
    assert TG.detect_problem(df, "y").problem_type == "regression"
    ts = df.selectExpr("*", "current_timestamp() AS t")
    assert TG.detect_problem(ts, "y").problem_type == "time_series"


def test_target_ranking_prefers_keyword(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(30)], "id int, target int, other int")
    best = TG.suggested_target(df)
    assert best["column"] == "target"


def test_confusion_and_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    cm = {(a, p): n for a, p, n in rows(EV.confusion_matrix(df, "y", "p"))}
    assert len(cm) == 9 and cm[("c", "c")] == 0 and cm[("c", "b")] == 1
    m = EV.classification_metrics(df, "y", "p").first()
    assert m["accuracy"] == 0.5
    # precision: a 1/1, b 1/3, c 0 (zero division → 0); weights 2,1,1
    assert math.isclose(m["precision"], (2 * 1 + 1 * (1 / 3) + 0) / 4)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert EV.roc_auc(df, "y", "s").first()[0] == 0.875


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "y double, p double")
    r = EV.regression_metrics(df, "y", "p").first()
    assert math.isclose(r["MSE"], 1 / 3) and math.isclose(r["R2"], 1 - 1 / 2)


def test_hash_split_share_and_stratified(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id % 3 AS STRING) AS c")
    share = SP.hash_split(df, "id").where("is_test").count() / 5000
    assert 0.18 < share < 0.22
    st = SP.stratified_split(df, "c", "id", k_folds=5)
    per = {r[0]: r[1] for r in st.where("is_test").groupBy("c").count().collect()}
    assert per == {"0": 333, "1": 333, "2": 333}
    folds = {r[0]: r[1] for r in st.groupBy("fold").count().collect()}
    assert set(folds) == {0, 1, 2, 3, 4} and max(folds.values()) - min(folds.values()) <= 3
