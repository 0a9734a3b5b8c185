"""Schema-level and driver-side helpers checked as units (SURVEY 'unit' rows)."""

from conftest import rows
from strata.operators import schema as S
from strata.operators import target as TG
from strata.plans import engineer as EN
from strata.plans import preprocess as PP


def test_trim_dedupe_and_validate_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" a", "a ", "b")
    out = S.trim_dedupe_columns(df)
    assert out.columns == ["a", "b"] and out.first()["a"] == 1
    ok, missing = S.validate_columns(out, ["b", "z", "a", "y"])
    assert not ok and missing == ["z", "y"]
    assert S.validate_columns(out, ["a"]) == (True, [])


def test_datetime_columns(spark):
    df = spark.createDataFrame([(1,)], "a int").selectExpr("a", "current_timestamp() AS t", "current_date() AS d")
    assert S.datetime_columns(df) == ["t", "d"] and S.has_datetime(df)
    assert not S.has_datetime(df.select("a"))


def test_select_kind(spark):
    df = spark.createDataFrame([(1, True, "x", 2.0)], "i int, b boolean, s string, f double")
    assert S.select_kind(df, "numeric").columns == ["i", "f"]
    assert S.select_kind(df, "boolean").columns == ["b"]


def test_suggested_problem(spark):
    df = spark.createDataFrame([(i, float(i) * 2.5, i % 2) for i in range(40)], "id int, price double, flag int")
    assert TG.suggested_problem(df) in ("classification", "regression")
    assert TG.suggested_target(df)["column"] == "price"


def test_feature_report_and_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 0.0, "b")], "x double, y double, s string")
    out, rep = EN.engineer_features(df)
    summ = dict(rows(EN.feature_report(spark, rep)))
    assert summ["Interaction Features"] == 1 and summ["Ratio Features"] == 1
    assert "x_x_y" in rep.generated() and rep.generated() == sorted(set(rep.generated()))
    assert set(rep.to_dict()) == {"interaction_features", "ratio_features", "aggregate_features",
                                  "removed_features", "warnings"}
    assert "s_frequency" in out.columns and "s_count" in out.columns


def test_preprocess_summary_and_pipeline_names(spark):
    df = spark.createDataFrame([(1.0, "a", True, 1), (None, "b", False, 0), (3.0, "a", None, 1),
                                (3.0, "a", None, 1)], "x double, c string, b boolean, y int")
    out, meta = PP.preprocess(df, target="y")
    steps = dict(rows(PP.preprocess_summary(meta, df)))
    assert steps["Duplicate Rows Removed"] == 1
    assert out.where("x IS NULL OR b IS NULL").count() == 0
    pipe, groups, _ = PP.build_preprocessor(out, target="y")
    model = pipe.fit(out)
    names = PP.transformed_feature_names(model, out)
    assert names[0] == "x" and any(n.startswith("c_") for n in names)
    assert PP.validate_pipeline(pipe, out)
