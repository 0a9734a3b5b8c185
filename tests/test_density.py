import numpy as np
import pytest

from strata.operators import charts as CH


def test_density_is_near_the_kernel_density_of_the_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(6, 0.5, 200)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    out = CH.density(df, "v").orderBy("value").collect()
    at, got = np.array([r["value"] for r in out]), np.array([r["density"] for r in out])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    h = 1.059 * min(x.std(ddof=1), (q3 - q1) / 1.349) * len(x) ** -0.2
    exact = np.exp(-0.5 * ((at[:, None] - x[None]) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert len(out) == 100 and at[0] == pytest.approx(x.min() - 2 * h) and at[-1] == pytest.approx(x.max() + 2 * h)
    assert np.abs(got - exact).max() < 0.002 * exact.max()
    assert np.trapezoid(got, at) == pytest.approx(1, abs=0.02)


def test_density_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(2, None), (2, None)], "k int, e double")
    assert [tuple(r) for r in CH.density(df, "k").collect()] == [(2.0, None)]
    assert CH.density(df, "e").count() == 0 and CH.density(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        CH.density(spark.range(9), "id", bandwidth=0.0)


def test_a_hot_value_leaves_a_bandwidth(spark):
    df = spark.createDataFrame([(1.0,)] * 90 + [(float(i),) for i in range(10)], "v double")  # iqr 0
    out = CH.density(df, "v", points=20).collect()
    assert len(out) == 20 and max(out, key=lambda r: r["density"])["value"] == pytest.approx(1, abs=0.6)
