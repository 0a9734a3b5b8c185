import math

from conftest import rows
from pyspark.sql import functions as F
from strata.functions.text import clean_text, word_count
from strata.operators import clean as C
from strata.operators import encode as E
from strata.operators import features as FE


def test_median_imputation_is_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    plan = C.fill_plan(df, ["x"], [], [], "median")
    assert plan.numeric["x"] == 2.5
    assert C.fill_plan(df, ["x"], [], [], "mean").numeric["x"] == 4.0


def test_mode_imputation_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", True), ("a", None), ("b", False), ("a", False), (None, True)],
                               "s string, b boolean")
    out = C.apply_fill(df, C.fill_plan(df, [], ["s"], ["b"]))
    assert out.where("s IS NULL OR b IS NULL").count() == 0
    assert sorted(r[0] for r in out.collect()) == ["a", "a", "a", "b", "b"]


def test_outlier_masks(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    flags = C.outlier_flags(df, ["x"], "iqr")
    assert [r[0] for r in flags.where("x_outlier").select("x").collect()] == [100.0]
    assert C.remove_outliers(df, ["x"], "iqr").count() == 5  # null row kept
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert C.outlier_flags(const, ["x"], "zscore").where("x_outlier").count() == 0


def test_remove_invalid_features(spark):
    df = spark.createDataFrame([(1.0, float("inf"), None, 2.0), (2.0, float("inf"), None, 2.0),
                                (3.0, 1.0, None, 2.0)], "a double, b double, c double, d double")
    out, removed = C.remove_invalid_features(df)
    assert sorted(removed) == ["c", "d"] and out.columns == ["a", "b"]
    assert out.where("b IS NULL").count() == 2


def test_drop_high_missing_boundary(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 3), (4, 4)], "a int, b int")
    assert C.drop_high_missing(df, 0.5)[1] == ["b"]


def test_row_aggregates(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 5.0), (None, None)], "a double, b double")
    out, _ = FE.row_aggregates(df, ["a", "b"])
    r = out.collect()
    assert (r[0]["row_sum"], r[0]["row_mean"], r[0]["row_range"]) == (4.0, 2.0, 2.0)
    assert math.isclose(r[0]["row_std"], math.sqrt(2))
    assert r[1]["row_std"] is None and r[1]["row_sum"] == 5.0
    assert r[2]["row_sum"] == 0.0 and r[2]["row_mean"] is None and r[2]["row_std"] is None


def test_ratios_and_reciprocal_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    out, names = FE.ratios(df, ["a", "b"])
    assert names == ["a_div_b"] and [r[0] for r in out.select("a_div_b").collect()] == [None, 2.0]
    assert [r[0] for r in FE.reciprocal(df, ["b"])[0].select("b_reciprocal").collect()] == [None, 0.5]


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    out, names = FE.polynomial(df, ["a", "b"])
    assert names == ["a^2", "a b", "b^2"] and out.first()["a b"] == 6.0


def test_log_skips_negative(spark):
    df = spark.createDataFrame([(1.0, -1.0, None)], "a double, n double, e double")
    assert FE.log_features(df, ["a", "n", "e"])[1] == ["a_log"]


def test_text_cleaning_unicode_whitespace(spark):
    df = spark.createDataFrame([("  Hello  World \t",), (None,), ("😀 x",)], "t string")
    out = df.select(clean_text(F.col("t")).alias("c"), word_count(F.col("t")).alias("w"),
                    F.length("t").alias("n"))
    r = out.collect()
    assert r[0]["c"] == "hello world" and r[0]["w"] == 2
    assert r[1]["c"] == "" and r[2]["n"] == 3 and r[2]["w"] == 2


def test_date_parts_and_cyclical(spark):
    df = spark.createDataFrame([("2024-01-06 10:30:00",), (None,)], "s string") \
        .selectExpr("to_timestamp(s) AS ts")
    out, _ = FE.date_part_features(df, ["ts"], with_time=True)
    r = out.collect()
    assert (r[0]["ts_dayofweek"], r[0]["ts_is_weekend"], r[0]["ts_week"]) == (5, 1, 1)
    assert r[1]["ts_is_weekend"] == 0
    cyc = FE.cyclical_features(df, ["ts"])[0].collect()[1]
    assert cyc["ts_month_sin"] == 0.0 and cyc["ts_month_cos"] == 1.0


def test_frequency_and_count_encoding(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "c string")
    f = [r[0] for r in E.frequency_encode(df, ["c"])[0].orderBy("c").select("c_frequency").collect()]
    c = [r[0] for r in E.count_encode(df, ["c"])[0].orderBy("c").select("c_count").collect()]
    assert f == [1.0, 2.0, 2.0] and c == [None, 2, 2]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, k double")
    st = E.scale(df, ["a", "k"], "standard").collect()
    assert [r["a"] for r in st] == [-1.0, 1.0] and [r["k"] for r in st] == [0.0, 0.0]
    mm = E.scale(df, ["a", "k"], "minmax").collect()
    assert [r["a"] for r in mm] == [0.0, 1.0] and [r["k"] for r in mm] == [0.0, 0.0]
    rb = E.scale(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "a double"), ["a"], "robust")
    assert [r[0] for r in rb.collect()] == [(1 - 2.5) / 3.0, (2 - 2.5) / 3.0, (3 - 2.5) / 3.0, (10 - 2.5) / 3.0]


def test_one_hot_and_ordinal_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    cats = E.categories(train, ["c"])
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    oh = E.one_hot_columns(test, ["c"], cats)[0].collect()
    assert [tuple(r) for r in oh] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    od = [r[0] for r in E.ordinal_columns(test, ["c"], cats).collect()]
    assert od == [0.0, -1.0, -1.0]


def test_count_encoding_of_hot_values_and_long_texts(spark):
    from strata.operators import encode as E
    data = [(i, "hot" if i % 2 else None if i % 3 else "x" * 100 + str(i % 5), i % 4) for i in range(600)]
    df = spark.createDataFrame(data, "id long, s string, n int")
    out, names = E.encode_counts(df, ["s", "n"])
    want = {}
    for _, s, n in data:
        want[s] = want.get(s, 0) + 1
    got = out.collect()
    assert len(got) == 600 and names == ["s_frequency", "s_count", "n_frequency", "n_count"]
    for r in got:
        assert r["s_frequency"] == want[r["s"]] and r["s_count"] == (None if r["s"] is None else want[r["s"]])
        assert r["n_count"] == 150
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, E.encode_counts(df, ["s", "n"])[0].collect())) == sorted(map(str, got))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_rows_of_a_hot_value_are_spread(spark):
    from pyspark.sql import functions as F
    from strata.operators.encode import count_encode
    df = spark.createDataFrame([("hot",)] * 900 + [("a",)] * 60 + [(None,)] * 40, "c string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out, _ = count_encode(df, ["c"])
        assert out.columns == ["c", "c_count"]
        assert {tuple(r) for r in out.collect()} == {("hot", 900), ("a", 60), (None, None)} and out.count() == 1000
        sizes = out.where("c = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_counts_of_few_values_move_no_rows(spark):
    from strata.operators import encode as E
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 7 < 6 THEN concat('v', id % 7) END AS s", "cast(id AS string) AS t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # every table is too large for Spark's own choice
    try:
        out, _ = E.encode_counts(df, ["s"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = {(r["s"], r["s_frequency"], r["s_count"]) for r in out.collect()}
        assert got == {(f"v{i}", n, n) for i, n in enumerate([572, 572, 572, 571, 571, 571])} | {(None, 571, None)}
        few, E.FEW_VALUES = E.FEW_VALUES, 3999  # one value too many
        try:
            many = E.encode_counts(df, ["t"])[0]
        finally:
            E.FEW_VALUES = few
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert many.where("t_count <> 1").isEmpty() and many.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_roundings_stay_out_of_whole_stage_code(spark):
    from pyspark.sql import functions as F
    from strata.queries.common import round_doubles
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([(0.1234565, None, float("nan"), float("inf"), -0.0)] * 2, "a double, b double, c double, d double, e double") \
        .select("*", *[(F.col("a") * i).alias(c) for i, c in enumerate(cols)], F.lit("x").alias("s"))
    out = round_doubles(df, 6, {"c3": 2, "c4": None})
    steps = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert steps and not any("round(" in s and "*(" in s.split("Project")[0] for s in steps)
    plain = df.select(*[c if c in ("c4", "s") else F.round(c, 2 if c == "c3" else 6).alias(c) for c in df.columns])
    assert out.dtypes == plain.dtypes and [str(r) for r in out.collect()] == [str(r) for r in plain.collect()]
    few = round_doubles(df.select("a", "b", "s"))
    assert [str(r) for r in few.collect()] == [str(r) for r in plain.select("a", "b", "s").collect()]
