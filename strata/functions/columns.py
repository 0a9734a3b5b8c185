"""Column kinds and null/NaN-safe scalar expressions.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType) -> bool:
    """Numeric without booleans (pandas ``select_dtypes(np.number)``)."""
    return isinstance(dt, NUMERIC_TYPES)


def is_numeric_or_bool(dt: T.DataType) -> bool:
    """pandas ``is_numeric_dtype``: booleans count as numeric."""
    return isinstance(dt, NUMERIC_TYPES + (T.BooleanType,))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_bool(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def kind_of(dt: T.DataType) -> str:
    """One of boolean, numeric, datetime, string, other (checked in that order)."""
    if is_bool(dt):
        return "boolean"
    if is_numeric(dt):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    if is_string(dt):
        return "string"
    return "other"


@dataclass
class SchemaKinds:
    numeric: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    string: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)


def schema_kinds(df: DataFrame, exclude: list[str] | tuple = ()) -> SchemaKinds:
    kinds = SchemaKinds()
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        getattr(kinds, kind_of(f.dataType)).append(f.name)
    return kinds


def col(name: str) -> Column:
    """Column reference that tolerates dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_value(name: str, dt: T.DataType) -> Column:
    """The column with NaN turned into NULL (NaN is a missing value)."""
    c = col(name)
    if is_fractional(dt):
        return F.nanvl(c, F.lit(None).cast(dt))
    return c


def as_double(name: str, dt: T.DataType) -> Column:
    """Double view of a numeric, boolean or datetime column; NaN → NULL."""
    c = col(name)
    if is_bool(dt):
        return c.cast("double")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(c.cast("timestamp")) / F.lit(1e6)).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double") * F.lit(86400.0)
    d = c.cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def safe_div(num: Column, den: Column) -> Column:
    """num / den with a zero divisor giving NULL (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson correlation; NULL on a constant input.

    ``F.corr`` raises DIVIDE_BY_ZERO on zero variance under ANSI mode, so the
    coefficient is assembled from population moments over complete pairs.
    """
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x)
    ys = F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys),
                        F.nullif(F.stddev_pop(xs) * F.stddev_pop(ys), F.lit(0.0)))


def quote_sql(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
