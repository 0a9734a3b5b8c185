"""Row-wise feature generators.

Every generator returns ``(DataFrame, created_names)`` and adds its columns in a
single ``select`` (never a chain of ``withColumn``).  Arithmetic is done in
double; a zero divisor gives NULL (ANSI mode would raise).
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import col, is_numeric, safe_div
from strata.functions.dates import CYCLE_PERIODS, cyclical, date_parts
from strata.functions.text import clean_text, text_length, word_count



def _d(name: str) -> Column:
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def _add(df: DataFrame, new: list[tuple[str, Column]]) -> tuple[DataFrame, list[str]]:
    if not new:
        return df, []
    return df.select("*", *[e.alias(n) for n, e in new]), [n for n, _ in new]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric (not boolean) columns in order."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def interaction_exprs(columns, max_pairs=None):
    return [(f"{a}_x_{b}", _d(a) * _d(b)) for a, b in list(combinations(columns, 2))[:max_pairs]]


def ratio_exprs(columns, max_pairs=None):
    return [(f"{a}_div_{b}", safe_div(_d(a), _d(b))) for a, b in list(combinations(columns, 2))[:max_pairs]]


def interactions(df, columns, max_pairs=None):
    """``a_x_b`` products of all pairs in column order (the first ``max_pairs`` if given)."""
    return _add(df, interaction_exprs(columns, max_pairs))


def ratios(df, columns, max_pairs=None):
    """``a_div_b`` quotients; a zero divisor gives NULL."""
    return _add(df, ratio_exprs(columns, max_pairs))


ROW_AGGREGATES = ("row_sum", "row_mean", "row_std", "row_min", "row_max", "row_range")


def add_row_aggregates(df: DataFrame, columns) -> tuple[DataFrame, list[str]]:
    """row_sum/mean/std (ddof 1)/min/max/range over ``columns``, skipping nulls;
    an all-null row sums to 0.  Nothing for fewer than two columns.

    Three projections: count/sum/min/max, then the mean, then the deviation
    around it by the two-pass formula.  The mean is a column of its own, so
    the deviation expression stays linear in the number of columns (Catalyst
    keeps a projection whose expensive output is used many times) and every
    step stays in whole-stage codegen."""
    if len(columns) < 2:
        return df, []
    vals = [_d(c) for c in columns]
    n = sum((v.isNotNull().cast("double") for v in vals), F.lit(0.0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    s1 = df.select("*", n.alias("__ra_n"), total.alias("row_sum"), F.least(*vals).alias("row_min"),
                   F.greatest(*vals).alias("row_max"))
    s2 = s1.select("*", F.try_divide(F.col("row_sum"), F.nullif(F.col("__ra_n"), F.lit(0.0))).alias("row_mean"))
    mean = F.col("row_mean")
    ss = sum((F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in vals), F.lit(0.0))
    s3 = s2.select("*", F.when(F.col("__ra_n") >= 2, F.sqrt(ss / (F.col("__ra_n") - 1))).alias("row_std"),
                   (F.col("row_max") - F.col("row_min")).alias("row_range")).drop("__ra_n")
    keep = [c for c in df.columns if c not in ROW_AGGREGATES]
    return s3.select(*[col(c) for c in keep], *ROW_AGGREGATES), list(ROW_AGGREGATES)


def row_aggregates(df, columns):
    return add_row_aggregates(df, columns)


def polynomial_exprs(columns, degree=2, interaction_only=False, existing=()):
    """All monomials of degree 2..degree, named like ``a^2`` and ``a b``; names
    already present are skipped."""
    out = []
    for d in range(2, degree + 1):
        combos = combinations(columns, d) if interaction_only else combinations_with_replacement(columns, d)
        for combo in combos:
            parts, counts = [], {}
            for c in combo:
                counts[c] = counts.get(c, 0) + 1
            for c in dict.fromkeys(combo):
                parts.append(c if counts[c] == 1 else f"{c}^{counts[c]}")
            name = " ".join(parts)
            if name in existing:
                continue
            e = None
            for c in combo:
                e = _d(c) if e is None else e * _d(c)
            out.append((name, e))
    return out


def polynomial(df, columns, degree=2, interaction_only=False):
    return _add(df, polynomial_exprs(columns, degree, interaction_only, set(df.columns)))


def column_minimums(df, columns) -> dict:
    if not columns:
        return {}
    row = df.agg(*[F.min(_d(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def log_exprs(columns, minimums):
    return [(f"{c}_log", F.log1p(_d(c))) for c in columns
            if minimums.get(c) is not None and minimums[c] >= 0]


def sqrt_exprs(columns, minimums):
    return [(f"{c}_sqrt", F.sqrt(_d(c))) for c in columns
            if minimums.get(c) is not None and minimums[c] >= 0]


def log_features(df, columns):
    """``c_log`` = log1p(c); a column is skipped when its minimum is < 0 or all null."""
    return _add(df, log_exprs(columns, column_minimums(df, columns)))


def sqrt_features(df, columns):
    return _add(df, sqrt_exprs(columns, column_minimums(df, columns)))


def power_exprs(columns):
    sq = [(f"{c}_squared", _d(c) * _d(c)) for c in columns]
    cu = [(f"{c}_cubed", _d(c) * _d(c) * _d(c)) for c in columns]
    ab = [(f"{c}_abs", F.abs(_d(c))) for c in columns]
    return sq, cu, ab


def squared(df, columns):
    return _add(df, power_exprs(columns)[0])


def cubed(df, columns):
    return _add(df, power_exprs(columns)[1])


def absolute(df, columns):
    return _add(df, power_exprs(columns)[2])


def reciprocal_exprs(columns):
    return [(f"{c}_reciprocal", safe_div(F.lit(1.0), _d(c))) for c in columns]


def reciprocal(df, columns):
    """``c_reciprocal`` = 1/c, 0 → NULL."""
    return _add(df, reciprocal_exprs(columns))


def date_part_exprs(columns, with_time=False):
    return [(f"{c}_{suffix}", e) for c in columns for suffix, e in date_parts(col(c), with_time)]


def date_part_features(df, columns, with_time=False, drop_original=False):
    """year, quarter, month, ISO week, day, dayofweek (Mon=0), dayofyear,
    [hour, minute,] is_weekend for each datetime column."""
    out, created = _add(df, date_part_exprs(columns, with_time))
    if drop_original:
        out = out.drop(*columns)
    return out, created


def cyclical_exprs(columns):
    out = []
    for c in columns:
        parts = dict(date_parts(col(c), True))
        for comp, period in CYCLE_PERIODS.items():
            s, co = cyclical(parts[comp], period)
            out += [(f"{c}_{comp}_sin", s), (f"{c}_{comp}_cos", co)]
    return out


def cyclical_features(df, columns):
    """sin/cos of month/12, day/31, dayofweek/7, dayofyear/365, hour/24,
    minute/60; a null part encodes as 0."""
    return _add(df, cyclical_exprs(columns))


def clean_text_columns(df, columns):
    """Apply ``clean_text`` to the given columns in place."""
    return df.select(*[clean_text(col(c)).alias(c) if c in columns else col(c) for c in df.columns])


def text_length_features(df, columns):
    """Fill the text column with '' and add ``c_length`` (code points) and
    ``c_word_count`` (whitespace words)."""
    filled = [F.coalesce(col(c).cast("string"), F.lit("")).alias(c) if c in columns else col(c)
              for c in df.columns]
    base = df.select(*filled)
    new = []
    for c in columns:
        new += [(f"{c}_length", text_length(col(c))), (f"{c}_word_count", word_count(col(c)))]
    return _add(base, new)


def safe_divide_scalar(num: Column, den: Column, default: float = 0.0) -> Column:
    """Scalar helper: a zero or NULL divisor gives ``default``."""
    return F.coalesce(safe_div(num, den), F.lit(float(default)))


def percentage(part: Column, whole: Column) -> Column:
    """part/whole·100 rounded to 2; a zero whole gives 0.0."""
    return F.round(safe_divide_scalar(part * F.lit(100.0), whole, 0.0), 2)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


# ---------------------------------------------------------------------------
# number formatting
# ---------------------------------------------------------------------------

def format_number(c: Column, decimals: int = 2, integral: bool = False) -> Column:
    """Thousands separators; integers as is, other numbers with ``decimals``
    places (half-even on the shortest decimal form)."""
    if integral:
        return F.format_number(c.cast("long"), 0)
    return F.format_number(c.cast("double"), decimals)


def _fixed2(c: Column) -> Column:
    # two decimals, no grouping
    return F.call_function("format_number", c, F.lit("0.00"))


def format_bytes(c: Column) -> Column:
    """B, KB, MB, GB, TB by powers of 1024 with 2 decimals; PB beyond."""
    v = c.cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    e = None
    for k, u in enumerate(units):
        scaled = v / F.lit(float(1024 ** k))
        cond = scaled < 1024
        txt = F.concat(_fixed2(scaled), F.lit(" " + u))
        e = F.when(cond, txt) if e is None else e.when(cond, txt)
    return e.otherwise(F.concat(_fixed2(v / F.lit(float(1024 ** 5))), F.lit(" PB")))


def format_duration(c: Column) -> Column:
    """seconds → 'x.xx sec' below a minute, 'x.xx min' below an hour, else 'x.xx hr'."""
    s = c.cast("double")
    return (F.when(s < 60, F.concat(_fixed2(s), F.lit(" sec")))
            .when(s / 60 < 60, F.concat(_fixed2(s / 60), F.lit(" min")))
            .otherwise(F.concat(_fixed2(s / 60 / 60), F.lit(" hr"))))
