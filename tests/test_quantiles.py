"""Exact quantiles against numpy, and what they bring to the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from strata.operators.quantiles import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(5)
    n = 4000
    return pd.DataFrame({
        "normal": rng.normal(size=n), "heavy": rng.standard_cauchy(n) * 1e6,
        "ties": rng.integers(0, 7, n).astype(float), "one": np.full(n, 3.5),
        "hot": np.where(rng.random(n) < 0.6, 1.0, rng.random(n)),
        "holes": np.where(rng.random(n) < 0.4, None, rng.normal(size=n)).astype(object)})


@pytest.mark.parametrize("accuracy,inside", [(10_000, 100_000), (50, 40), (20, 5)])
def test_equal_numpy_at_every_sketch_size(spark, columns, accuracy, inside):
    pdf = columns.astype(float)
    got = quantiles(_rows(spark, columns), list(pdf.columns), PROBS, accuracy=accuracy, inside=inside)
    for c in pdf.columns:
        want = np.quantile(pdf[c].dropna(), PROBS)
        assert np.allclose(got[c], want, rtol=1e-12, atol=0), c


def test_the_driver_receives_one_row_per_order_statistic(spark, columns, monkeypatch):
    seen = []
    collect = DataFrame.collect

    def counted(self):
        rows = collect(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    quantiles(_rows(spark, columns), list(columns.columns), [0.25, 0.5, 0.75])
    assert sum(seen) and max(seen) <= len(columns.columns) * 3 * 2


def test_no_values(spark):
    d = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert quantiles(d, ["a", "b"], [0.5]) == {"a": None, "b": [1.0]}
    assert quantiles(d.limit(0), ["a", "b"], [0.5]) == {"a": None, "b": None}
    assert quantiles(d, [], [0.5]) == {}


def _rows(spark, pdf):
    rows = [tuple(None if v is None or v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(4)
