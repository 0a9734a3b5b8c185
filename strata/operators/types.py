"""Type inference, feature groups and type tightening."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import col, is_datetime, is_string, kind_of
from strata.operators.profile import _fields, column_profile

TEXT_RATIO = 0.70

# String forms accepted as booleans when a column holds at most
# two of them (case-insensitive).
BOOL_TRUE = ("true", "yes", "1")
BOOL_FALSE = ("false", "no", "0")

# Date/time layouts tried for datetime strings, in order of preference on ties.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd.MM.yyyy",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "MM/dd/yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm:ss",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)


def _group_case(kind: Column, text_rule: Column) -> Column:
    return (F.when(kind == "boolean", "boolean").when(kind == "numeric", "numeric")
            .when(kind == "datetime", "datetime")
            .when(kind == "string", F.when(text_rule, "text").otherwise("categorical"))
            .otherwise(F.lit(None)))


def _ratio() -> Column:
    return F.coalesce(F.try_divide(F.col("unique").cast("double"), F.col("rows").cast("double")),
                      F.lit(0.0))


def feature_groups(df: DataFrame, target: str | None = None,
                   text_ratio: float = TEXT_RATIO, profile: DataFrame | None = None) -> DataFrame:
    """(column, feature_group): boolean → numeric → datetime → string; a string
    column is text when distinct/rows ≥ text_ratio, else categorical.  The target
    and nested columns are left out."""
    cols = [c for c in df.columns if c != target]
    prof = (profile.filter(F.col("column") != F.lit(target)) if target else profile) \
        if profile is not None else column_profile(df, cols)
    grp = _group_case(F.col("kind"), _ratio() >= text_ratio)
    return prof.select("column", grp.alias("feature_group")).filter(F.col("feature_group").isNotNull())


def feature_types_eda(df: DataFrame, text_ratio: float = TEXT_RATIO,
                      min_avg_len: float = 25.0, profile: DataFrame | None = None) -> DataFrame:
    """(column, feature_group), EDA rules: text if ratio > .70 or mean length
    (null counted as length 0) > 25."""
    prof = profile if profile is not None else column_profile(df)
    rule = (_ratio() > text_ratio) | (F.coalesce(F.col("avg_len0"), F.lit(0.0)) > min_avg_len)
    grp = _group_case(F.col("kind"), rule)
    return prof.select("column", grp.alias("feature_group")).filter(F.col("feature_group").isNotNull())


def text_columns(df: DataFrame, min_avg_len: float = 20.0, text_ratio: float = TEXT_RATIO,
                 rule: str = "length_or_ratio") -> DataFrame:
    """(column, avg_length, unique_ratio) of string columns judged to be text.

    ``rule="length_or_ratio"``: mean non-null length ≥ min_avg_len or ratio ≥
    text_ratio (mean length 0.0 when all null); ``rule="ratio"``: ratio only.
    """
    strings = [f.name for f in df.schema.fields if is_string(f.dataType)]
    if not strings:
        return df.sparkSession.createDataFrame([], "column string, avg_length double, unique_ratio double")
    prof = column_profile(df, strings).select(
        "column", F.coalesce("avg_len", F.lit(0.0)).alias("avg_length"), _ratio().alias("unique_ratio"))
    cond = F.col("unique_ratio") >= text_ratio
    if rule == "length_or_ratio":
        cond = (F.col("avg_length") >= min_avg_len) | cond
    return prof.filter(cond)


def infer_types(df: DataFrame, max_categories: int = 20) -> DataFrame:
    """(column, inferred_type): boolean / numeric / datetime by type; other
    columns categorical with ≤ max_categories distinct non-null values, else text."""
    prof = column_profile(df)
    k = F.col("kind")
    t = (F.when(k == "boolean", "boolean").when(k == "numeric", "numeric")
         .when(k == "datetime", "datetime")
         .when(F.col("unique") <= max_categories, "categorical").otherwise("text"))
    return prof.select("column", t.alias("inferred_type"))


# ---------------------------------------------------------------------------
# tightening
# ---------------------------------------------------------------------------

_INT_RANGES = (("tinyint", -128, 127), ("smallint", -32768, 32767),
               ("int", -2147483648, 2147483647))


def tightening_plan(df: DataFrame, float_tolerance: float = 5e-4) -> dict[str, str]:
    """Target type per column that can be narrowed, from one aggregate job.

    Integers: smallest signed type holding [min, max].  Doubles: float when no
    value moves by more than ``float_tolerance``.  Strings: boolean when the
    distinct lower-cased non-null values are at most two and all boolean words.
    """
    aggs, plan_inputs = [], []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        dt = f.dataType
        if isinstance(dt, (T.ShortType, T.IntegerType, T.LongType, T.ByteType)):
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
            plan_inputs.append((i, f, "int"))
        elif isinstance(dt, T.DoubleType):
            v = F.nanvl(c, F.lit(None).cast("double"))
            moved = F.abs(v - v.cast("float").cast("double"))
            aggs.append(F.max(moved).alias(f"mv{i}"))
            aggs.append(F.max(F.abs(v)).alias(f"ab{i}"))
            plan_inputs.append((i, f, "float"))
        elif is_string(dt):
            low = F.lower(c)
            words = F.lit(list(BOOL_TRUE + BOOL_FALSE))
            aggs.append(F.count_if(c.isNotNull() & ~F.array_contains(words, low)).alias(f"nb{i}"))
            # distinct boolean words seen, at most 6: bounded collect
            aggs.append(F.collect_set(F.when(F.array_contains(words, low), low)).alias(f"bw{i}"))
            plan_inputs.append((i, f, "bool"))
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    plan = {}
    for i, f, how in plan_inputs:
        if how == "int":
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is None:
                continue
            for name, a, b in _INT_RANGES:
                if a <= lo and hi <= b:
                    if name != f.dataType.simpleString():
                        plan[f.name] = name
                    break
        elif how == "float":
            mv, ab = row[f"mv{i}"], row[f"ab{i}"]
            if mv is not None and mv <= float_tolerance and ab is not None and ab < 3.4e38:
                plan[f.name] = "float"
        else:
            if row[f"nb{i}"] == 0 and len(row[f"bw{i}"]) <= 2 and len(row[f"bw{i}"]) > 0:
                plan[f.name] = "boolean"
    return plan


def apply_tightening(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        target = plan.get(f.name)
        if target == "boolean":
            low = F.lower(c)
            out.append(F.when(low.isin(*BOOL_TRUE), True).when(low.isin(*BOOL_FALSE), False)
                       .otherwise(F.lit(None).cast("boolean")).alias(f.name))
        elif target:
            out.append(c.cast(target).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def tighten_types(df: DataFrame, float_tolerance: float = 5e-4) -> DataFrame:
    """Narrow integer, float and boolean-like string columns (one aggregate job,
    then a lazy projection)."""
    return apply_tightening(df, tightening_plan(df, float_tolerance))


# ---------------------------------------------------------------------------
# datetime strings
# ---------------------------------------------------------------------------

#: no layout prints a longer value; longer strings are not tried
_LONGEST_DATE = 40


#: what a field of a layout looks like once every digit is a 9, and the bounds of two-digit fields
_FIELD_SHAPES = {"yyyy": "9999", "MM": "99", "dd": "99", "HH": "99", "mm": "99", "ss": "99", "M": "9+", "d": "9+", "H": "9+",
                 "MMM": "[^0-9]+", "MMMM": "[^0-9]+", "XXX": "(?:Z|[+-]99:99)", **{"S" * n: f"9{{1,{n}}}" for n in range(1, 10)}}
_FIELD_BOUNDS = {"MM": ("01", "12"), "dd": ("01", "31"), "HH": ("00", "23"), "mm": ("00", "59"), "ss": ("00", "59")}


def _shape(c: Column) -> Column:
    """The value with every digit as 9 (null beyond the longest date), which layouts are matched with."""
    return F.when(F.length(c) <= _LONGEST_DATE, F.translate(c, "0123456789", "9999999999"))


def _may_parse(c: Column, shape: Column, fmt: str) -> Column:
    """False only where ``fmt`` cannot parse the value: its shape differs, or a field is out of bounds.

    A failed parse costs far more than this test.  Signs (as of years beyond 9999) and layouts
    with other fields are not judged."""
    pattern, bounds, at, fixed, least = "", [], 1, True, 0
    for literal, field in re.findall(r"'([^']*)'|([A-Za-z]+|[^A-Za-z'])", fmt):
        text = literal or field
        known = None if literal or not field[0].isalpha() else _FIELD_SHAPES.get(field)
        if known is None and not literal and field[0].isalpha():
            return F.lit(True)
        plain = known is None or set(known) == {"9"}
        if known is not None and fixed and field in _FIELD_BOUNDS:
            bounds.append(F.substring(c, at, len(field)).between(*_FIELD_BOUNDS[field]))
        pattern += known or re.escape(text)
        fixed, at = fixed and plain, at + len(text)
        least += len(text) if plain else 1
    same = shape == re.sub(r"\\(.)", r"\1", pattern) if fixed else (
        (F.length(shape) >= least) & shape.rlike(f"^{pattern}$"))
    return reduce(lambda a, b: a & b, bounds, same) | F.startswith(shape, F.lit("+")) | F.startswith(shape, F.lit("-"))


def _parsed(c: Column, fmt: str, shape: Column | None = None) -> Column:
    return F.try_to_timestamp(F.when(_may_parse(c, _shape(c) if shape is None else shape, fmt), c), F.lit(fmt))


def datetime_detection(df: DataFrame, threshold: float = 0.80, formats=DATETIME_FORMATS) -> DataFrame:
    """(column, format, parsed_ratio, unparsed, is_datetime) for string and datetime columns.

    Over all rows, the values that a layout parses are counted per column; a layout is tried only on values of its shape.  A column's format is the layout that parses most of them (the
    earlier one on ties); ``parsed_ratio`` is its share of all rows (nulls count as
    failures) and ``unparsed`` the number of values it does not parse.
    """
    spark = df.sparkSession
    strings = [f.name for f in df.schema.fields if is_string(f.dataType)]
    rows = [(f.name, None, 1.0, 0, True) for f in df.schema.fields if is_datetime(f.dataType)]
    if strings:
        got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"v{i}") for i, c in enumerate(strings)]).first()
        # long form, so the layouts are compiled once and not per column; without a digit there is no date
        values = df.select(F.posexplode(F.array(*[col(c) for c in strings])).alias("i", "v"))
        shaped = values.select("i", "v", _shape(F.col("v")).alias("s")).where(F.contains(F.col("s"), F.lit("9")))
        parsed = {r["i"]: r[1:] for r in shaped.groupBy("i").agg(
            *[F.count(_parsed(F.col("v"), fmt, F.col("s"))) for fmt in formats]).collect()}
        for i, c in enumerate(strings):
            counts = parsed.get(i, [0] * len(formats))
            best = max(range(len(formats)), key=lambda j: (counts[j], -j))
            if counts[best]:
                ratio = counts[best] / got["n"]
                rows.append((c, formats[best], ratio, got[f"v{i}"] - counts[best], ratio >= threshold))
            else:
                rows.append((c, None, 0.0, got[f"v{i}"], False))
    return spark.createDataFrame(
        rows, "column string, format string, parsed_ratio double, unparsed long, is_datetime boolean")


def detect_datetime(df: DataFrame, **kw) -> list[str]:
    return [r["column"] for r in datetime_detection(df, **kw).filter("is_datetime").collect()]


def parse_datetime(df: DataFrame, detection: DataFrame | None = None, lossy: bool = False, **kw) -> DataFrame:
    """Convert detected datetime strings with their format.

    A column of which some value does not parse stays as it is, so nothing is lost;
    ``lossy=True`` converts it too and turns those values into NULL.  The counts of
    such values are in ``datetime_detection``'s ``unparsed``.
    """
    det = detection if detection is not None else datetime_detection(df, **kw)
    keep = "is_datetime AND format IS NOT NULL" + ("" if lossy else " AND unparsed = 0")
    formats = {r["column"]: r["format"] for r in det.filter(keep).collect()}
    out = [_parsed(col(f.name), formats[f.name]).alias(f.name) if f.name in formats
           else col(f.name) for f in df.schema.fields]
    return df.select(*out)


def column_kinds_df(df: DataFrame) -> DataFrame:
    """(column, dtype, kind) from the schema alone."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), kind_of(f.dataType)) for f in _fields(df)],
        "column string, dtype string, kind string")
