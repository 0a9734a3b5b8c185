"""Chart data sets.  The reference draws figures; these return
the aggregated data a figure needs, computed by Spark."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import as_double, col, is_numeric, is_numeric_or_bool
from strata.operators import profile as P
from strata.operators.schema import sample_rows

HIST_BINS = 30
SCATTER_SAMPLE = 10_000
PAIR_SAMPLE = 500
MISSING = "Missing"


def histogram(df: DataFrame, column: str, bins: int = HIST_BINS) -> DataFrame:
    """(bin, lower, upper, count) over ``bins`` equal-width bins between the
    column's min and max; the maximum falls in the last bin; empty bins are 0."""
    dt = df.schema[column].dataType
    v = as_double(column, dt)
    lo_hi = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = lo_hi["lo"], lo_hi["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    if hi == lo:
        n = df.agg(F.count(v).alias("n")).first()["n"]
        return spark.createDataFrame([(1, float(lo), float(hi), int(n))],
                                     "bin int, lower double, upper double, count long")
    b = F.least(F.floor(F.lit(float(bins)) * (v - F.lit(lo)) / F.lit(hi - lo)).cast("long") + 1,
                F.lit(bins)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def box_stats(df: DataFrame, column: str, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """One row: q1, median, q3, iqr, lower_whisker, upper_whisker (extreme
    values inside the fences), n_outliers — two aggregate jobs."""
    from strata.operators.quantiles import quantiles
    v = as_double(column, df.schema[column].dataType)
    qs = quantiles(df, [column], [0.25, 0.5, 0.75], "approx" if approx else "exact")[column]
    if qs is None:
        return df.sparkSession.createDataFrame(
            [], "q1 double, median double, q3 double, iqr double, lower_whisker double, "
                "upper_whisker double, n_outliers long")
    q1, q2, q3 = qs
    iqr = q3 - q1
    lo_f, hi_f = q1 - factor * iqr, q3 + factor * iqr
    inside = (v >= lo_f) & (v <= hi_f)
    return df.agg(F.min(F.when(inside, v)).alias("lower_whisker"), F.max(F.when(inside, v)).alias("upper_whisker"),
                  F.count_if(v.isNotNull() & ~inside).cast("long").alias("n_outliers")).select(
        F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"), F.lit(iqr).alias("iqr"),
        "lower_whisker", "upper_whisker", "n_outliers")


def box_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """The outlier points themselves (a filter with literal fences)."""
    from strata.operators.quantiles import quantiles
    v = as_double(column, df.schema[column].dataType)
    qs = quantiles(df, [column], [0.25, 0.75])[column]
    if qs is None:
        return df.select(v.alias(column)).where(F.lit(False))
    iqr = qs[1] - qs[0]
    return df.select(v.alias(column)).where((F.col(column) < qs[0] - factor * iqr) |
                                            (F.col(column) > qs[1] + factor * iqr))


#: bins of the histogram that a density is made from, and points of its curve
DENSITY_BINS, DENSITY_POINTS = 512, 100


def density(df: DataFrame, column: str, points: int = DENSITY_POINTS, bins: int = DENSITY_BINS,
            bandwidth: float | None = None) -> DataFrame:
    """(value, density): the curve of a violin plot at ``points`` equally spaced values.

    A Gaussian kernel density over a histogram of ``bins`` equal bins, whose rows count at
    the middle of their bin: one aggregate for the range, one for the counts, and only
    those reach the driver.  ``bandwidth`` None is the normal reference rule, 1.059 x
    min(deviation, iqr / 1.349) x n^(-1/5); the curve runs two bandwidths beyond both ends.
    A column without spread has one row with a null density; one without values has none.
    """
    from strata.operators.quantiles import quantiles
    v = as_double(column, df.schema[column].dataType)
    spark, schema = df.sparkSession, "value double, density double"
    stats = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.stddev_samp(v).alias("sd")).first()
    lo, hi, n = stats["lo"], stats["hi"], stats["n"]
    if not n or hi == lo or not math.isfinite(hi - lo):
        return spark.createDataFrame([(float(lo), None)] if n else [], schema)
    if bandwidth is None:
        q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
        bandwidth = 1.059 * (min(stats["sd"], (q3 - q1) / 1.349) if q3 > q1 else stats["sd"]) * n ** -0.2
    if bandwidth <= 0:
        raise ValueError("bandwidth must be positive")
    b = F.least(F.floor(F.lit(float(bins)) * (v - F.lit(lo)) / F.lit(hi - lo)).cast("int"), F.lit(bins - 1))
    counts = np.zeros(bins)
    for r in df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["bin"]] = r["n"]
    middle = lo + (np.arange(bins) + 0.5) * ((hi - lo) / bins)
    at = np.linspace(lo - 2 * bandwidth, hi + 2 * bandwidth, points)
    kernel = np.exp(-0.5 * ((at[:, None] - middle[None, :]) / bandwidth) ** 2)
    curve = kernel @ counts / (n * bandwidth * math.sqrt(2 * math.pi))
    return spark.createDataFrame(list(zip(at.tolist(), curve.tolist())), schema)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(Category, Count) with NULL shown as 'Missing', most frequent first."""
    cat = F.coalesce(col(column).cast("string"), F.lit(MISSING))
    return (df.groupBy(cat.alias("Category")).agg(F.count(F.lit(1)).alias("Count"))
            .orderBy(F.desc("Count"), F.asc("Category")))


def scatter_sample(df: DataFrame, x: str, y: str, color: str | None = None, id_col=None,
                   n: int = SCATTER_SAMPLE, seed: int = 42) -> DataFrame:
    cols = [x, y] + ([color] if color else [])
    ids = id_col or df.columns
    keep = list(dict.fromkeys(([ids] if isinstance(ids, str) else list(ids)) + cols))
    return sample_rows(df.select(*[col(c) for c in keep]), n, id_col=ids, seed=seed).select(*[col(c) for c in cols])


def correlation_long(df: DataFrame, digits: int = 2) -> DataFrame:
    """(x, y, r) rounded for the heatmap; empty without numeric columns."""
    c = P.correlation(df, min_columns=1)
    return c.select("x", "y", F.round("r", digits).alias("r"))


def missing_matrix(df: DataFrame, id_col: str, blocks: int = 50) -> DataFrame:
    """(block, column, null_share): rows grouped into ``blocks`` equal-width
    ranges of ``id_col``; one group-by with an average per column, unpivoted after it."""
    ids = df.agg(F.min(col(id_col)).alias("lo"), F.max(col(id_col)).alias("hi")).first()
    lo, hi = ids["lo"], ids["hi"]
    span = float(hi - lo + 1) if lo is not None else 1.0
    block = F.least(F.floor((col(id_col).cast("double") - F.lit(float(lo or 0))) / F.lit(span) * blocks),
                    F.lit(blocks - 1)).cast("int")
    shares = df.groupBy(block.alias("block")).agg(*[
        F.avg(P._is_missing(f).cast("int")).alias(f"s{i}") for i, f in enumerate(df.schema.fields)])
    return shares.select("block", F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f"s{i}").alias("null_share"))
        for i, f in enumerate(df.schema.fields)])))


def pair_sample(df: DataFrame, id_col=None, n: int = PAIR_SAMPLE, seed: int = 42) -> DataFrame:
    """Numeric columns of ``n`` sampled rows; empty (no columns) with fewer than
    two numeric columns."""
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if len(num) < 2:
        return df.select().where(F.lit(False))
    ids = id_col or df.columns
    return sample_rows(df, n, id_col=ids, seed=seed).select(*[col(c) for c in num])


def target_distribution(df: DataFrame, target: str, bins: int = HIST_BINS) -> DataFrame | None:
    """Histogram for a numeric target, value counts otherwise; None if absent."""
    if target not in df.columns:
        return None
    if is_numeric_or_bool(df.schema[target].dataType):
        return histogram(df, target, bins)
    return value_counts(df, target)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
