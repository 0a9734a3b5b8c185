import math

from conftest import rows
from strata.operators import profile as P


def _t(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", None), (2, float("nan"), "a", None), (3, 3.0, None, None), (3, 3.0, None, None)],
        "k int, x double, s string, e string")


def test_missing_counts_nan_is_missing(spark):
    m = dict(rows(P.missing_counts(_t(spark))))
    assert m == {"k": 0, "x": 1, "s": 2, "e": 4}


def test_missing_percent_rounding_and_empty(spark):
    m = dict(rows(P.missing_percent(_t(spark))))
    assert m["s"] == 50.0 and m["x"] == 25.0
    empty = spark.createDataFrame([], "a int")
    assert rows(P.missing_percent(empty)) == [("a", 0.0)]


def test_duplicate_rows_nulls_equal(spark):
    r = P.duplicate_rows(_t(spark)).first()
    assert (r["rows"], r["duplicate_rows"], r["duplicate_percent"]) == (4, 1, 25.0)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (1, None, None, "x")], "a int, b string, c int, d string")
    # c has one value and a null: two distinct values with nulls counted → not constant
    assert sorted(r[0] for r in rows(P.constant_columns(df))) == ["a", "b", "d"]


def test_high_cardinality_boundary(spark):
    df = spark.range(100).selectExpr("cast(id as string) AS s", "cast(id % 3 as string) AS t")
    assert rows(P.high_cardinality(df, 100)) == [("s", 100)]
    assert rows(P.high_cardinality(df, 101)) == []
    


def test_feature_statistics(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (4.0, None)], "x double, b boolean")
    st = {r["column"]: r for r in P.feature_statistics(df).collect()}
    assert st["x"]["unique"] == 3 and math.isclose(st["x"]["std"], 1.5275252316519468)
    assert st["b"]["mean"] == 0.5 and st["b"]["missing"] == 1


def test_describe_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    r = P.describe(df).first()
    assert (r["top"], r["freq"], r["unique"]) == ("a", 2, 3)


def test_describe_quartiles_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = P.describe(df).first()
    assert (r["q25"], r["q50"], r["q75"]) == (1.75, 2.5, 4.75)


def test_correlation_constant_and_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)],
                               "a double, b double, c double")
    r = {(x, y): v for x, y, v in rows(P.correlation(df))}
    assert math.isclose(r[("a", "b")], 1.0) and r[("a", "c")] is None and r[("c", "c")] is None
    assert r[("a", "a")] == 1.0


def test_memory_usage(spark):
    df = spark.createDataFrame([(1, "é")], "a int, s string")
    assert P.memory_usage(df).first()["bytes"] == 4 + 2


def test_quantiles_ranks_equal_map(spark):
    from strata.operators.quantiles import quantiles
    df = spark.range(1001).selectExpr("CAST((id * 7919) % 1000 AS DOUBLE) / 7.0 AS a",
                                      "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 10 AS DOUBLE) END AS b",
                                      "CAST(NULL AS DOUBLE) AS e")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    m = quantiles(df, ["a", "b", "e"], probs, "map")
    r = quantiles(df, ["a", "b", "e"], probs, "ranks")
    assert m["e"] is None and r["e"] is None
    for c in ("a", "b"):
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(m[c], r[c]))


def test_correlation_of_a_pair_far_from_the_column_mean(spark):
    df = spark.createDataFrame([(0.0, None) for _ in range(500)] + [(1e6 + t, float(t)) for t in range(500)],
                               "x double, y double")
    got = {(r["x"], r["y"]): r["r"] for r in P.correlation(df).collect()}
    assert abs(got[("x", "y")] - 1.0) < 1e-9 and got[("x", "x")] == 1.0


def test_correlation_of_many_columns_is_one_scan(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 60)), columns=[f"c{i}" for i in range(60)]).mask(
        rng.random((400, 60)) < 0.1)
    got = P.correlation(spark.createDataFrame(pdf).repartition(5)).toPandas().pivot(index="x", columns="y", values="r")
    want = pdf.corr()
    assert abs(got.loc[want.index, want.columns] - want).max().max() < 1e-9


def test_long_texts_are_counted_by_digest(spark):
    a, b = "x" * 200 + "a", "x" * 200 + "b"
    df = spark.createDataFrame([(b,), (b,), (a,), (a,), ("short",), (None,)], "s string")
    assert rows(P.high_cardinality(df, 3)) == [("s", 3)]
    m = P.modes(df).first()
    assert (m["top"], m["freq"]) == (a, 2)  # the smaller of the two most frequent
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 2
    plan = P.duplicate_rows(df)._jdf.queryExecution().toString()
    assert "sha2" in plan


def test_quantiles_with_ties_and_rounds(spark):
    import numpy as np
    import pandas as pd

    from strata.operators.quantiles import quantiles
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=20_000), "b": rng.integers(0, 3, 20_000).astype(float),
                        "c": np.exp(30 * rng.normal(size=20_000)), "d": np.where(rng.random(20_000) < .3, np.nan, 1.5)})
    df, probs = spark.createDataFrame(pdf).repartition(4), [0, .25, .5, .75, .9, 1]
    for accuracy, inside in ((10_000, 100_000), (100, 200), (150, 20)):
        got = quantiles(df, list(pdf), probs, accuracy=accuracy, inside=inside)
        for c in pdf:
            assert np.allclose(got[c], pdf[c].quantile(probs).to_numpy(), rtol=0, atol=0), (c, accuracy)
