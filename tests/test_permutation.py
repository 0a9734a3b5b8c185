import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.permute import keyed_permutation, permuted_places
from strata.plans import train as TR


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_keyed_permutations_are_bijections(n):
    seen = [keyed_permutation(np.arange(n), n, key) for key in (0, 1, 42, 2 ** 70 + 5)]
    for p in seen:
        assert sorted(p.tolist()) == list(range(n))
    if n >= 1000:
        assert len({tuple(p.tolist()) for p in seen}) == 4
        assert abs(np.corrcoef(np.arange(n), seen[2])[0, 1]) < 0.1 and (seen[2] == np.arange(n)).sum() < 10
        steps = np.diff(seen[2])
        assert len(set(steps.tolist())) > n / 4  # no fixed stride
    part = keyed_permutation(np.arange(n)[::-1], n, 42)
    assert (part == seen[2][::-1]).all()  # a place does not depend on the others asked for


def test_places_in_spark(spark):
    got = spark.range(500).repartition(3).select("id", permuted_places(F.col("id"), 500, [1, 2]).alias("p")).collect()
    for j, key in enumerate((1, 2)):
        assert {r["id"]: r["p"][j] for r in got} == dict(enumerate(keyed_permutation(np.arange(500), 500, key).tolist()))


def plain_loop(spark, res, repeats, seed):
    """Every feature and repeat on its own, the permuted column made on the driver."""
    data = sorted((r.asDict() for r in res.test.collect()), key=lambda r: str(r["id"]))
    schema = res.test.schema

    def score(rows):
        df = spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)
        pred = res.model.transform(TR._with_label(res.prep.transform(df), res.target, res.labels))
        return TR.score_expr_df(pred, res.problem).first()[0]

    base, out = score(data), {}
    for f in res.features:
        drops = []
        for r in range(repeats):
            to = keyed_permutation(np.arange(len(data)), len(data), seed + r)
            moved = [dict(row) for row in data]
            for d, row in enumerate(data):
                moved[to[d]][f] = row[f]
            drops.append(base - score(moved))
        out[f] = (np.mean(drops), np.std(drops))
    return out


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_equals_a_plain_loop(spark, problem):
    d = spark.range(300).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("x"),
                                (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 10).alias("noise"),
                                F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("cat"))
    if problem == "classification":
        d, name = d.withColumn("y", F.when(F.col("x") + 2 * (F.col("cat") == "a").cast("int") > 6, "hi").otherwise("lo")), "Logistic Regression"
    else:
        d, name = d.withColumn("y", 3 * F.col("x") + 2 * (F.col("cat") == "b").cast("int")), "Linear Regression"
    d = d.withColumn("y", F.when(F.col("y").isNull(), F.lit(0).cast(d.schema["y"].dataType)).otherwise(F.col("y")))
    res = TR.train_model(d, "y", name, problem, ["x", "noise", "cat"], "id", TR.TrainConfig(cross_validation=False))
    got = {r["feature"]: (r["importance_mean"], r["importance_std"])
           for r in TR.permutation_importance(res, res.test, "id", repeats=3).collect()}
    want = plain_loop(spark, res, 3, 42)
    assert got.keys() == want.keys() and min(got, key=got.get) == "noise"
    for f, w in want.items():
        assert got[f] == pytest.approx(w, abs=1e-9), f


def test_no_rows(spark):
    d = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    res = TR.train_model(d, "y", "Logistic Regression", "classification", ["x"], "id", TR.TrainConfig(cross_validation=False))
    assert TR.permutation_importance(res, res.test.limit(0), "id", repeats=2).count() == 0
