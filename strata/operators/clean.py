"""Cleaning: duplicates, column drops, imputation, outliers.

Each step computes its decision in at most one aggregate job (per-column
numbers, O(columns) on the driver) and then applies it as a lazy projection or
a filter with literal bounds, which Catalyst can push into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import (as_double, col, is_bool, is_fractional, is_numeric,
                                      is_string, schema_kinds)
from strata.operators import profile as P

HIGH_MISSING = 0.50
HIGH_CARDINALITY = 100
IQR_FACTOR = 1.5
Z_THRESHOLD = 3.0


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows (nulls compare equal)."""
    return df.dropDuplicates()


def drop_constant(df: DataFrame, target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns with ≤ 1 distinct value (nulls counted), except the target."""
    cols = [c for c in df.columns if c != target]
    if not cols:
        return df, []
    removed = [r["column"] for r in P.constant_flags(df, cols).filter("is_constant").collect()]
    return df.drop(*removed), removed


def drop_high_missing(df: DataFrame, threshold: float = HIGH_MISSING,
                      target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns whose null share is ≥ threshold, except the target."""
    cols = [c for c in df.columns if c != target]
    if not cols:
        return df, []
    share = P.missing_percent(df, cols, rounded=False).collect()
    removed = [r["column"] for r in share if r["missing_percent"] / 100.0 >= threshold]
    return df.drop(*removed), removed


def drop_high_cardinality(df: DataFrame, threshold: int = HIGH_CARDINALITY,
                          target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop string columns with ≥ threshold distinct non-null values, except the target."""
    hc = [r["column"] for r in P.high_cardinality(df, threshold).collect()]
    removed = [c for c in df.columns if c in hc and c != target]
    return df.drop(*removed), removed


# ---------------------------------------------------------------------------
# imputation
# ---------------------------------------------------------------------------

@dataclass
class FillPlan:
    numeric: dict = field(default_factory=dict)
    categorical: dict = field(default_factory=dict)
    boolean: dict = field(default_factory=dict)


def _numeric_fill_aggs(cols, dtypes, strategy, approx):
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(c, dtypes[c])
        if strategy == "mean":
            a = F.avg(v)
        elif strategy == "constant":
            a = F.lit(0.0)
        else:
            raise ValueError(f"unknown numeric strategy {strategy}")
        aggs.append(a.alias(f"n{i}"))
    return aggs


def fill_plan(df: DataFrame, numeric: list[str], categorical: list[str], boolean: list[str],
              numeric_strategy: str = "median", categorical_strategy: str = "most_frequent",
              approx: bool = False) -> FillPlan:
    """Fill values per column from at most two jobs (an aggregate and the
    frequency count for modes)."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    plan = FillPlan()
    mode_cols = list(boolean) + list(categorical if categorical_strategy == "most_frequent" else [])
    if numeric_strategy == "most_frequent":
        mode_cols += list(numeric)
    elif numeric and numeric_strategy == "median":
        from strata.operators.quantiles import quantiles
        qs = quantiles(df, list(numeric), [0.5], "approx" if approx else "exact")
        plan.numeric = {c: (qs[c][0] if qs.get(c) else None) for c in numeric}
    elif numeric:
        row = df.agg(*_numeric_fill_aggs(numeric, dtypes, numeric_strategy, approx)).first()
        plan.numeric = {c: row[f"n{i}"] for i, c in enumerate(numeric)}
    if categorical_strategy == "constant":
        plan.categorical = {c: "missing_value" for c in categorical}
    if mode_cols:
        top = {r["column"]: r for r in P.modes(df, mode_cols).collect()}
        for c in mode_cols:
            r = top.get(c)
            if c in boolean:
                plan.boolean[c] = None if r is None or r["top"] is None else r["top"] == "true"
            elif c in categorical:
                plan.categorical[c] = None if r is None else r["top"]
            else:
                v = None if r is None else (r["top_d"] if r["top_d"] is not None else r["top_l"])
                plan.numeric[c] = None if v is None else float(v)
    return plan


def apply_fill(df: DataFrame, plan: FillPlan) -> DataFrame:
    """Numeric columns become double with nulls filled; strings and booleans
    are filled in place.  A column with no fill value (all null) stays null."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in plan.numeric:
            v = as_double(c, dtypes[c])
            fill = plan.numeric[c]
            out.append((F.coalesce(v, F.lit(float(fill))) if fill is not None else v).alias(c))
        elif c in plan.categorical and plan.categorical[c] is not None:
            out.append(F.coalesce(col(c), F.lit(plan.categorical[c])).alias(c))
        elif c in plan.boolean and plan.boolean[c] is not None:
            out.append(F.coalesce(col(c), F.lit(plan.boolean[c])).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def fill_missing(df: DataFrame, target: str | None = None, numeric_strategy: str = "median",
                 categorical_strategy: str = "most_frequent", groups=None,
                 approx: bool = False) -> DataFrame:
    """Impute numeric (median default), categorical (most frequent, smallest on
    ties) and boolean (mode) columns; text and datetime columns and the target
    are left alone."""
    if groups is None:
        from strata.plans.preprocess import detect_groups
        groups = detect_groups(df, target)
    plan = fill_plan(df, groups.numeric, groups.categorical, groups.boolean,
                     numeric_strategy, categorical_strategy, approx)
    return apply_fill(df, plan)


# ---------------------------------------------------------------------------
# outliers
# ---------------------------------------------------------------------------

def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr",
                   factor: float = IQR_FACTOR, threshold: float = Z_THRESHOLD,
                   approx: bool = False) -> dict[str, tuple]:
    """(low, high) bounds per column from one aggregate over the whole table.

    iqr: [Q1 − factor·IQR, Q3 + factor·IQR] with exact quartiles (``approx`` for
    percentile_approx); zscore: mean ± threshold·std (ddof 1), None when the
    deviation is 0 or undefined (no outliers).
    """
    if not columns:
        return {}
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    if method == "zscore":
        row = df.agg(*[a for i, c in enumerate(columns) for a in (
            F.avg(as_double(c, dtypes[c])).alias(f"m{i}"),
            F.stddev_samp(as_double(c, dtypes[c])).alias(f"s{i}"))]).first()
    else:
        from strata.operators.quantiles import quantiles
        qs = quantiles(df, list(columns), [0.25, 0.75], "approx" if approx else "exact")
    for i, c in enumerate(columns):
        if method == "zscore":
            m, s = row[f"m{i}"], row[f"s{i}"]
            out[c] = None if (s is None or s == 0 or m is None) else (m, s)
        else:
            q = qs.get(c)
            if q is None or q[0] is None:
                out[c] = None
            else:
                iqr = q[1] - q[0]
                out[c] = (q[0] - factor * iqr, q[1] + factor * iqr)
    return out


def outlier_mask(c: Column, bounds, method: str = "iqr", threshold: float = Z_THRESHOLD) -> Column:
    """True where the value is an outlier; NULL values and undefined bounds → False."""
    if bounds is None:
        return F.lit(False)
    if method == "zscore":
        m, s = bounds
        return F.coalesce(F.abs((c - F.lit(m)) / F.lit(s)) > threshold, F.lit(False))
    lo, hi = bounds
    return F.coalesce((c < F.lit(lo)) | (c > F.lit(hi)), F.lit(False))


def outlier_flags(df: DataFrame, columns: list[str], method: str = "iqr", **kw) -> DataFrame:
    """The input plus one boolean ``<col>_outlier`` per column."""
    bounds = outlier_bounds(df, columns, method, **kw)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return df.select("*", *[outlier_mask(as_double(c, dtypes[c]), bounds[c], method)
                            .alias(f"{c}_outlier") for c in columns])


def _iqr_keep(name: str, dt, lo: float, hi: float) -> Column:
    """Keep-predicate for fences [lo, hi] written on the raw column so each
    conjunct can reach the parquet reader as a pushed filter.  NaN sorts above
    every number in Spark, so only the upper fence needs the NaN escape
    (NaN is a missing value, never an outlier)."""
    import math
    c = col(name)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        low = (c >= F.lit(int(math.ceil(lo)))) | c.isNull()
        high = (c <= F.lit(int(math.floor(hi)))) | c.isNull()
        return low & high
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        low = (c >= F.lit(float(lo))) | c.isNull()
        high = (c <= F.lit(float(hi))) | c.isNull() | F.isnan(c)
        return low & high
    return ~outlier_mask(as_double(name, dt), (lo, hi), "iqr")


def remove_outliers(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                    **kw) -> DataFrame:
    """Keep rows that are an outlier in no numeric column; bounds come from the
    unfiltered table and enter the plan as literals.  IQR fences are written
    on the raw columns, so the lower-fence conjuncts (and both fences of
    integer columns) are pushed to the parquet scan."""
    if columns is None:
        columns = schema_kinds(df).numeric
    if not columns:
        return df
    bounds = outlier_bounds(df, columns, method, **kw)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    keep = F.lit(True)
    for c in columns:
        if bounds[c] is None:
            continue
        if method == "zscore":
            keep = keep & ~outlier_mask(as_double(c, dtypes[c]), bounds[c], method)
        else:
            keep = keep & _iqr_keep(c, dtypes[c], *bounds[c])
    return df.filter(keep)


# ---------------------------------------------------------------------------
# invalid engineered features
# ---------------------------------------------------------------------------

def remove_invalid_features(df: DataFrame, protect: tuple | list = (),
                            batch: int = 20) -> tuple[DataFrame, list[str]]:
    """Drop all-null columns; turn ±inf into NULL; drop columns that are then
    constant (nulls counted as a value).

    Per column: count, min and max of the cleaned value (NaN and ±inf → NULL)
    and, for floating columns, the number of infinities — 3–4 plain aggregates,
    issued as SQL text in batches of ``batch`` columns so each job stays
    within whole-stage codegen."""
    fields = [f for f in df.schema.fields if f.name not in protect]
    names = {f.name: f"__c{i}" for i, f in enumerate(df.schema.fields)}
    flat = df.toDF(*[names[f.name] for f in df.schema.fields])
    removed, has_inf = [], set()
    for start in range(0, len(fields), batch):
        chunk = fields[start:start + batch]
        aggs = ["count(1) AS __rows"]
        for i, f in enumerate(chunk, start):
            c = names[f.name]
            if is_fractional(f.dataType):
                clean = f"CASE WHEN isnan({c}) OR abs({c}) = double('inf') THEN NULL ELSE {c} END"
                aggs.append(f"count_if(abs({c}) = double('inf')) AS inf{i}")
            elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
                clean = f"to_json({c})"
            else:
                clean = c
            aggs += [f"count({clean}) AS c{i}", f"min({clean}) AS lo{i}", f"max({clean}) AS hi{i}"]
        row = flat.selectExpr(*aggs).first()
        n = row["__rows"]
        for i, f in enumerate(chunk, start):
            inf = row[f"inf{i}"] if is_fractional(f.dataType) else 0
            cnt, lo, hi = row[f"c{i}"], row[f"lo{i}"], row[f"hi{i}"]
            if cnt + inf == 0:
                removed.append(f.name)        # all null (or NaN)
                continue
            if inf > 0:
                has_inf.add(f.name)
            if cnt == 0 or (cnt == n and lo == hi):
                removed.append(f.name)        # constant once infinities are null
    out = []
    for f in df.schema.fields:
        if f.name in removed:
            continue
        if f.name in has_inf:
            c = col(f.name)
            out.append(F.when(F.abs(c) == float("inf"), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out), removed
