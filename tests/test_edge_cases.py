"""Empty, single-row, all-null and extreme inputs."""

import math

import pytest
from conftest import rows
from strata.operators import charts as CH
from strata.operators import evaluate as EV
from strata.operators import health as H
from strata.operators import profile as P
from strata.operators import target as TG


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "a double, s string, t timestamp")


@pytest.fixture()
def one(spark):
    return spark.createDataFrame([(1.5, "x", None)], "a double, s string, t timestamp")


def test_profile_on_empty(spark, empty):
    assert dict(rows(P.missing_counts(empty))) == {"a": 0, "s": 0, "t": 0}
    fs = {r["column"]: r for r in P.feature_statistics(empty).collect()}
    assert fs["a"]["non_null"] == 0 and fs["a"]["mean"] is None and fs["s"]["unique"] == 0
    d = P.duplicate_rows(empty).first()
    assert (d["rows"], d["duplicate_rows"], d["duplicate_percent"]) == (0, 0, 0.0)
    assert sorted(r[0] for r in rows(P.constant_columns(empty))) == ["a", "s", "t"]
    assert P.describe(empty).count() == 3
    assert P.dataset_summary(empty).first()["rows"] == 0


def test_health_on_empty_and_one_row(spark, empty, one):
    assert H.health_score(empty).first()[0] >= 0
    assert H.health_score(one).first()[0] >= 0
    r = H.health_report(one).first()
    assert r["score"] <= 100 and isinstance(r["warnings"], list)


def test_single_row_statistics(spark, one):
    fs = {r["column"]: r for r in P.feature_statistics(one).collect()}
    assert fs["a"]["std"] is None and fs["a"]["mean"] == 1.5
    assert rows(P.correlation(one, min_columns=1)) == [("a", "a", None)]


def test_infinities_nan_negative_zero(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (-0.0,), (0.0,)], "x double")
    fs = P.feature_statistics(df).first()
    assert fs["missing"] == 1 and fs["unique"] == 3      # -0.0 and 0.0 are one value; NaN is missing
    assert rows(P.constant_columns(df)) == []


def test_charts_on_empty(spark, empty):
    assert CH.histogram(empty, "a").count() == 0
    assert CH.value_counts(empty, "s").count() == 0
    assert CH.box_stats(empty, "a").count() == 0
    assert CH.target_distribution(empty, "nope") is None


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, s double")
    assert EV.roc_auc(df, "y", "s").first()[0] is None


def test_target_scores_on_single_column(spark, one):
    sc = TG.target_scores(one.select("a")).first()
    assert 0 <= sc["confidence"] <= 100


def test_all_null_column_problem_type(spark):
    df = spark.createDataFrame([(None,), (None,)], "y double")
    r = TG.problem_type(df, "y").first()
    assert r["problem_type"] in ("classification", "regression")
    with pytest.raises(ValueError):
        TG.problem_type(df, "missing_col")


def test_names_with_spaces_and_dots(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`a b` double, `c.d` double")
    assert sorted(r[0] for r in rows(P.missing_counts(df), "column")) == ["a b", "c.d"]
    assert math.isclose(P.correlation(df, min_columns=1).count(), 4)
