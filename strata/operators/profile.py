"""Fused column profiling.

Two jobs cover every profile statistic of a table:

* one global ``agg`` computes per-column counts and moments (map-side partial
  aggregation, a single-row result, no shuffle of data);
* one long-form ``groupBy(column, value).count()`` computes exact value
  frequencies for all columns at once (one shuffle, partial aggregation before
  it), from which distinct counts, modes and constant flags follow.

Results are small long-form DataFrames (one row per column), unpivoted from
the single aggregate row inside Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import (as_double, col, is_bool, is_datetime,
                                      is_fractional, is_numeric,
                                      is_numeric_or_bool, is_string, kind_of, pearson)

# fixed widths (bytes) used by the memory estimate; strings use their UTF-8 size
_TYPE_WIDTH = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4,
    T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}

#: strings longer than this many bytes are counted by a digest
SHORT_BYTES = 64
#: characters of a long string kept in front of its digest, so that keys order as values do
PREFIX_CHARS = 24


def _fields(df: DataFrame, columns=None) -> list[T.StructField]:
    if columns is None:
        return list(df.schema.fields)
    by_name = {f.name: f for f in df.schema.fields}
    return [by_name[c] for c in columns]


def _unpivot_row(row_df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct (stays in Spark)."""
    if not structs:
        raise ValueError("nothing to unpivot")
    return row_df.select(F.inline(F.array(*structs)))


def fixed(report: DataFrame) -> DataFrame:
    """A report (one row per column of a table) computed once, for several uses."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


# ---------------------------------------------------------------------------
# value frequencies (long form)
# ---------------------------------------------------------------------------

def short_key(c: Column) -> Column:
    """The string itself if it is short, else its beginning, a marker and its SHA-256.

    Equal strings have equal keys, and a key that stands for a long string is itself
    longer than ``SHORT_BYTES``, so it equals no short string.  Grouping by it moves at
    most some 160 bytes per value however long the texts are.
    """
    return F.when(F.octet_length(c) <= SHORT_BYTES, c).otherwise(
        F.concat(F.substring(c, 1, PREFIX_CHARS), F.lit("\x01"), F.sha2(c, 256)))


def row_keys(df: DataFrame) -> list[Column]:
    """Grouping keys that are equal for equal rows (nulls compare equal), long strings as digests."""
    return [(short_key(col(f.name)) if is_string(f.dataType) else col(f.name)).alias(f"k{i}")
            for i, f in enumerate(df.schema.fields)]


def _value_struct(pos: int, f: T.StructField, digest: bool) -> Column:
    c = col(f.name)
    dt = f.dataType
    vl = F.lit(None).cast("long")
    vd = F.lit(None).cast("double")
    vs = F.lit(None).cast("string")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        vl = c.cast("long")
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        vl = F.unix_micros(c.cast("timestamp"))
    elif isinstance(dt, T.DateType):
        vl = F.unix_date(c).cast("long")
    elif is_fractional(dt) or isinstance(dt, T.DecimalType):
        # -0.0 and 0.0 group together (Spark normalises floating keys)
        vd = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    elif is_bool(dt) or is_string(dt):
        vs = c.cast("string")
    else:
        vs = F.to_json(c) if isinstance(dt, (T.StructType, T.MapType, T.ArrayType)) \
            else c.cast("string")
    if digest and not is_bool(dt):
        vs = short_key(vs)
    return F.struct(F.lit(pos).alias("pos"), vl.alias("vl"), vd.alias("vd"), vs.alias("vs"))


def frequencies(df: DataFrame, columns=None, digest: bool = False) -> DataFrame:
    """(pos, vl, vd, vs, n): exact count of every value of every column.

    ``pos`` is the column position in ``columns``; the value sits in exactly
    one of vl (integral / datetime), vd (floating) and vs (string / boolean);
    all three NULL is the missing value.  With ``digest`` long strings are
    counted (and given) as ``short_key``.
    """
    fields = _fields(df, columns)
    exploded = df.select(F.inline(F.array(*[_value_struct(i, f, digest) for i, f in enumerate(fields)])))
    return exploded.groupBy("pos", "vl", "vd", "vs").agg(F.count(F.lit(1)).alias("n"))


def _names_df(df: DataFrame, fields) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(fields)],
        "pos int, column string, dtype string, kind string")


def distinct_counts(df: DataFrame, columns=None) -> DataFrame:
    """(pos, column, unique, unique_with_null): exact distinct counts."""
    fields = _fields(df, columns)
    if not fields:
        return _empty(df, "pos int, column string, unique long, unique_with_null long")
    freq = frequencies(df, [f.name for f in fields], digest=True)
    missing = F.col("vl").isNull() & F.col("vd").isNull() & F.col("vs").isNull()
    counts = freq.groupBy("pos").agg(
        F.count_if(~missing).alias("unique"),
        F.count(F.lit(1)).alias("unique_with_null"))
    names = _names_df(df, fields)
    return (names.join(F.broadcast(counts), "pos", "left")
            .select("pos", "column",
                    F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
                    F.coalesce("unique_with_null", F.lit(0)).cast("long").alias("unique_with_null")))


def modes(df: DataFrame, columns=None) -> DataFrame:
    """(pos, column, top, freq): most frequent non-null value, smallest on ties.

    ``top`` is rendered as a string.  Done with aggregates over the frequency
    table (no window over a whole column's distinct values).
    """
    fields = _fields(df, columns)
    freq = frequencies(df, [f.name for f in fields], digest=True)
    nonnull = freq.filter(F.col("vl").isNotNull() | F.col("vd").isNotNull() | F.col("vs").isNotNull())
    best = nonnull.groupBy("pos").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), "vl", "vd", "vs")).alias("b"))
    rendered = F.coalesce(F.col("b.vs"), F.col("b.vl").cast("string"), F.col("b.vd").cast("string"))
    names = _names_df(df, fields)
    out = (names.join(F.broadcast(best), "pos", "left")
           .select("pos", "column", rendered.alias("top"),
                   (-F.col("b.neg_n")).cast("long").alias("freq"),
                   F.col("b.vl").alias("top_l"), F.col("b.vd").alias("top_d")))
    if not any(is_string(f.dataType) for f in fields):
        return out
    return _long_winners(df, fields, freq, out)


def _long_winners(df: DataFrame, fields, freq: DataFrame, winners: DataFrame) -> DataFrame:
    """Put the texts in place of digests that won: one row per string column is looked at, and
    only rows that begin like the winner are read for the value."""
    won = winners.collect()
    texts = {}
    for r in won:
        f = fields[r["pos"]]
        if not is_string(f.dataType) or r["top"] is None or len(r["top"].encode()) <= SHORT_BYTES:
            continue
        start = r["top"][:-65]  # without the marker and the digest
        c = col(f.name)
        tied = (freq.where((F.col("pos") == r["pos"]) & (F.col("n") == r["freq"]))
                .where(F.substring("vs", 1, len(start)) == F.lit(start)).select("vs"))
        same = df.where(F.substring(c, 1, len(start)) == F.lit(start)).select(c.alias("v"), short_key(c).alias("vs"))
        texts[r["pos"]] = same.join(tied, "vs", "left_semi").agg(F.min("v")).first()[0]
    rows = [(r["pos"], r["column"], texts.get(r["pos"], r["top"]), r["freq"], r["top_l"], r["top_d"]) for r in won]
    return df.sparkSession.createDataFrame(
        rows, "pos int, column string, top string, freq long, top_l long, top_d double")


# ---------------------------------------------------------------------------
# missing values
# ---------------------------------------------------------------------------

def _is_missing(f: T.StructField) -> Column:
    c = col(f.name)
    if is_fractional(f.dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_counts_row(df: DataFrame, columns=None) -> tuple[DataFrame, list[T.StructField]]:
    fields = _fields(df, columns)
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.count_if(_is_missing(f)).alias(f"m{i}") for i, f in enumerate(fields)]
    return df.agg(*aggs), fields


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, missing)."""
    row, fields = null_counts_row(df, columns)
    return _unpivot_row(row, [F.struct(F.lit(f.name).alias("column"),
                                       F.col(f"m{i}").cast("long").alias("missing"))
                              for i, f in enumerate(fields)])


def missing_percent(df: DataFrame, columns=None, rounded: bool = True) -> DataFrame:
    """(column, missing_percent): share of nulls ×100; 0.0 on an empty table.

    ``rounded=True`` rounds to 2 decimals (inspector flavour); ``False`` keeps the
    exact share (helper flavour, reported in descending order by the caller).
    """
    row, fields = null_counts_row(df, columns)
    structs = []
    for i, f in enumerate(fields):
        pct = F.coalesce(F.try_divide(F.col(f"m{i}") * F.lit(100.0), F.col("__rows").cast("double")),
                         F.lit(0.0))
        if rounded:
            pct = F.round(pct, 2)
        structs.append(F.struct(F.lit(f.name).alias("column"), pct.alias("missing_percent")))
    return _unpivot_row(row, structs)


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing_values, percentage) sorted by percentage desc, then name."""
    row, fields = null_counts_row(df)
    structs = [F.struct(F.lit(f.name).alias("column"),
                        F.col(f"m{i}").cast("long").alias("missing_values"),
                        F.coalesce(F.round(F.try_divide(F.col(f"m{i}") * F.lit(100.0),
                                                        F.col("__rows").cast("double")), 2),
                                   F.lit(0.0)).alias("percentage"))
               for i, f in enumerate(fields)]
    return _unpivot_row(row, structs).orderBy(F.desc("percentage"), F.asc("column"))


# ---------------------------------------------------------------------------
# duplicates, constants, cardinality
# ---------------------------------------------------------------------------

def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows, duplicate_percent): rows equal to an earlier row.

    Groups on all columns (nulls compare equal, long strings by digest), map-side combined.
    """
    grouped = df.groupBy(*row_keys(df)).agg(F.count(F.lit(1)).alias("__n"))
    return grouped.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    ).select("rows", "duplicate_rows",
             F.coalesce(F.round(F.try_divide(F.col("duplicate_rows") * F.lit(100.0),
                                             F.col("rows").cast("double")), 2),
                        F.lit(0.0)).alias("duplicate_percent"))


def _constant_flag(f: T.StructField, i: int) -> tuple[list[Column], Column]:
    """Aggregates and the final flag for `nunique(dropna=False) <= 1` without distinct."""
    c = col(f.name)
    dt = f.dataType
    if is_fractional(dt):
        v = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    elif isinstance(dt, (T.StructType, T.MapType, T.ArrayType)):
        v = F.to_json(c)
    else:
        v = c
    aggs = [F.count(v).alias(f"c{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    flag = (F.col(f"c{i}") == 0) | ((F.col(f"c{i}") == F.col("__rows")) & (F.col(f"lo{i}") == F.col(f"hi{i}")))
    return aggs, flag


def constant_flags(df: DataFrame, columns=None) -> DataFrame:
    """(pos, column, is_constant) for every column, from one aggregate."""
    fields = _fields(df, columns)
    aggs, flags = [F.count(F.lit(1)).alias("__rows")], []
    for i, f in enumerate(fields):
        a, fl = _constant_flag(f, i)
        aggs += a
        flags.append(fl)
    row = df.agg(*aggs)
    return _unpivot_row(row, [F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("column"),
                                       fl.alias("is_constant"))
                              for i, (f, fl) in enumerate(zip(fields, flags))])


def constant_columns(df: DataFrame) -> DataFrame:
    """(column): columns with at most one distinct value, nulls counted as a value."""
    if not df.columns:
        return _empty(df, "column string")
    return constant_flags(df).filter("is_constant").select("column")


def high_cardinality(df: DataFrame, threshold: int = 50) -> DataFrame:
    """(column, unique): string columns with ≥ threshold distinct non-null values, counted exactly."""
    strings = [f.name for f in df.schema.fields if is_string(f.dataType)]
    if not strings:
        return _empty(df, "column string, unique long")
    counts = distinct_counts(df, strings)
    return counts.filter(F.col("unique") >= threshold).select("column", "unique")


# ---------------------------------------------------------------------------
# statistics
# ---------------------------------------------------------------------------

def _moment_aggs(i: int, f: T.StructField) -> list[Column]:
    v = as_double(f.name, f.dataType)
    return [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
            F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}")]


def feature_statistics(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, missing, unique, min, max, mean, std).

    min/max/mean/std (ddof=1) for numeric and boolean columns, NULL otherwise.
    """
    fields = _fields(df)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(~_is_missing(f)).alias(f"nn{i}"))
        if is_numeric_or_bool(f.dataType):
            aggs += _moment_aggs(i, f)
    row = df.agg(*aggs)
    null_d = F.lit(None).cast("double")
    structs = []
    for i, f in enumerate(fields):
        numeric = is_numeric_or_bool(f.dataType)
        structs.append(F.struct(
            F.lit(i).alias("pos"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"nn{i}").cast("long").alias("non_null"),
            (F.col("__rows") - F.col(f"nn{i}")).cast("long").alias("missing"),
            (F.col(f"mn{i}") if numeric else null_d).alias("min"),
            (F.col(f"mx{i}") if numeric else null_d).alias("max"),
            (F.col(f"av{i}") if numeric else null_d).alias("mean"),
            (F.col(f"sd{i}") if numeric else null_d).alias("std"),
        ))
    stats = _unpivot_row(row, structs)
    uniq = distinct_counts(df).select("pos", "unique")
    return (stats.join(F.broadcast(uniq), "pos")
            .select("column", "dtype", "non_null", "missing", "unique",
                    "min", "max", "mean", "std"))


def describe(df: DataFrame, approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """One row per column: count, unique, top, freq, mean, std, min, q25, q50, q75, max.

    Numeric columns get the moments and exact (or ``approx``) quartiles;
    datetimes the same in epoch seconds (std NULL); string and boolean columns
    get unique/top/freq (top: most frequent, smallest on ties).
    """
    from strata.operators.quantiles import quantiles
    fields = _fields(df)
    spark = df.sparkSession
    numish = [f.name for f in fields if kind_of(f.dataType) in ("numeric", "datetime")]
    qs = quantiles(df, numish, [0.25, 0.5, 0.75], "approx" if approx else "exact")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(~_is_missing(f)).alias(f"nn{i}"))
        k = kind_of(f.dataType)
        if k in ("numeric", "datetime"):
            aggs += _moment_aggs(i, f)
            q = qs.get(f.name)
            aggs.append((F.array(*[F.lit(float(x)) for x in q]) if q else
                         F.lit(None).cast("array<double>")).alias(f"q{i}"))
    row = df.agg(*aggs)
    null_d = F.lit(None).cast("double")
    structs = []
    for i, f in enumerate(fields):
        k = kind_of(f.dataType)
        num = k in ("numeric", "datetime")
        structs.append(F.struct(
            F.lit(i).alias("pos"), F.lit(f.name).alias("column"),
            F.col(f"nn{i}").cast("long").alias("count"),
            (F.col(f"av{i}") if num else null_d).alias("mean"),
            (F.col(f"sd{i}") if k == "numeric" else null_d).alias("std"),
            (F.col(f"mn{i}") if num else null_d).alias("min"),
            (F.col(f"q{i}")[0] if num else null_d).alias("q25"),
            (F.col(f"q{i}")[1] if num else null_d).alias("q50"),
            (F.col(f"q{i}")[2] if num else null_d).alias("q75"),
            (F.col(f"mx{i}") if num else null_d).alias("max"),
        ))
    stats = _unpivot_row(row, structs)
    cats = [f.name for f in fields if kind_of(f.dataType) in ("string", "boolean")]
    if cats:
        pos_of = {f.name: i for i, f in enumerate(fields)}
        remap = F.create_map(*[x for c in cats for x in (F.lit(cats.index(c)), F.lit(pos_of[c]))])
        top = modes(df, cats).select(remap[F.col("pos")].alias("pos"), "top", "freq")
        uniq = distinct_counts(df, cats).select(remap[F.col("pos")].alias("pos"), "unique")
        cat_stats = uniq.join(top, "pos")
    else:
        cat_stats = spark.createDataFrame([], "pos int, unique long, top string, freq long")
    return (stats.join(F.broadcast(cat_stats), "pos", "left")
            .select("column", "count", "unique", "top", "freq", "mean", "std", "min",
                    "q25", "q50", "q75", "max"))


#: a pair whose variance is a smaller share than this of its sum of squares is computed again on its own
_CANCELLED = 1e-6
_PAIRS_PER_JOB = 25


def _pair_sums(base: DataFrame, means: list[float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) per pair of columns over the rows that have both, from one
    scan: every Arrow batch adds the cross products of its shifted values and of its masks, a task
    returns one row per pair."""
    import numpy as np
    import pyarrow as pa

    k = len(means)
    left, right = np.triu_indices(k)

    def run(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns], axis=1)
            mask = ~np.isnan(x)
            x = np.where(mask, x - np.array(means), 0.0)
            m, sq = mask.astype(float), x * x
            for t, part in enumerate((m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x)):
                total[t] += part
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int32()), pa.array(right, pa.int32()), *(pa.array(t[left, right]) for t in total)],
            ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = base.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlation(df: DataFrame, columns=None, min_columns: int = 2) -> DataFrame:
    """Long-form Pearson matrix (x, y, r) over numeric columns.

    Pairwise-complete: a pair uses the rows where both values are present.  One
    job finds each column's mean, one scan gathers the sums of all pairs over
    mean-shifted values (``_pair_sums``); what reaches the driver is one row per
    pair of columns.  A pair whose rows lie so far from the column means that its
    sums cancel is computed again from stable moments of its own rows.  Zero
    spread over the pair's rows gives NULL (pandas NaN); the diagonal is 1.0
    unless the column is constant.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if len(columns) < min_columns or not columns:
        return _empty(df, "x string, y string, r double")
    dts = {f.name: f.dataType for f in df.schema.fields}
    base = df.select(*[as_double(c, dts[c]).alias(f"v{i}") for i, c in enumerate(columns)])
    first = base.agg(*[F.avg(f"v{i}") for i in range(len(columns))]).first()
    sums = {(r["i"], r["j"]): r for r in _pair_sums(base, [m if m is not None else 0.0 for m in first]).collect()}
    out, again = {}, []
    for (i, j), r in sums.items():
        n = r["n"]
        vx, vy = (r[q] - r[s] * r[s] / n if n else 0.0 for q, s in (("sxx", "sx"), ("syy", "sy")))
        if n < 2:
            out[i, j] = None
        elif vx <= _CANCELLED * r["sxx"] or vy <= _CANCELLED * r["syy"]:
            again.append((i, j))
        else:
            out[i, j] = 1.0 if i == j else (r["sxy"] - r["sx"] * r["sy"] / n) / (vx * vy) ** 0.5
    for at in range(0, len(again), _PAIRS_PER_JOB):
        some = again[at:at + _PAIRS_PER_JOB]
        aggs = []
        for k, (i, j) in enumerate(some):
            x, y = F.col(f"v{i}"), F.col(f"v{j}")
            both = x.isNotNull() & y.isNotNull()
            flat = (F.min(F.when(both, x)) == F.max(F.when(both, x))) | (F.min(F.when(both, y)) == F.max(F.when(both, y)))
            aggs.append(F.when(~flat, F.lit(1.0) if i == j else pearson(x, y)).alias(f"r{k}"))
        row = base.agg(*aggs).first()
        out.update({pair: row[f"r{k}"] for k, pair in enumerate(some)})
    rows = [(columns[i], columns[j], out.get((i, j))) for i in range(len(columns)) for j in range(i, len(columns))]
    rows += [(y, x, r) for x, y, r in rows if x != y]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def memory_bytes_expr(df: DataFrame, per_row: bool = False) -> Column:
    """Estimated in-memory bytes: of the table (aggregate) or of one row."""
    fixed = 0
    strings = []
    for f in df.schema.fields:
        w = None
        for t, width in _TYPE_WIDTH.items():
            if isinstance(f.dataType, t):
                w = width
        if w is None:
            strings.append(F.octet_length(col(f.name).cast("string")) if is_string(f.dataType)
                           else F.octet_length(F.to_json(F.struct(col(f.name)))))
        else:
            fixed += w
    row_bytes = F.lit(fixed).cast("long")
    for s in strings:
        row_bytes = row_bytes + F.coalesce(s, F.lit(0)).cast("long")
    if per_row:
        return row_bytes
    return F.coalesce(F.sum(row_bytes), F.lit(0)).cast("long")


def memory_usage(df: DataFrame) -> DataFrame:
    """(bytes, memory_mb): fixed type widths × rows + UTF-8 size of strings."""
    return df.agg(memory_bytes_expr(df).alias("bytes")).select(
        "bytes", F.round(F.col("bytes") / F.lit(1024.0 ** 2), 2).alias("memory_mb"))


def scan_metrics(df: DataFrame) -> DataFrame:
    """(metric, value): rows, missing_cells, bytes (plain scan) and duplicate_rows (grouped keys)."""
    fields = _fields(df)
    row_missing = reduce(lambda a, b: a + b, [F.when(_is_missing(f), 1).otherwise(0) for f in fields], F.lit(0))
    plain = df.agg(F.count(F.lit(1)).cast("double").alias("rows"),
                   F.coalesce(F.sum(row_missing), F.lit(0)).cast("double").alias("missing_cells"),
                   memory_bytes_expr(df).cast("double").alias("bytes"))
    grouped = df.groupBy(*row_keys(df)).agg(F.count(F.lit(1)).alias("__n"))
    dups = grouped.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("double").alias("duplicate_rows"))
    return reduce(DataFrame.unionByName, [
        one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])))
        for one in (plain, dups)])


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, memory MB, columns per kind.

    Counts and bytes come from a plain aggregate; only the duplicate count needs
    a grouping, by keys in which long strings are digests.
    """
    fields = _fields(df)
    kinds = [kind_of(f.dataType) for f in fields]
    m = scan_metrics(df)
    names = ("rows", "missing_cells", "duplicate_rows", "bytes")
    return m.agg(*[F.coalesce(F.max(F.when(F.col("metric") == k, F.col("value"))), F.lit(0.0)).cast("long").alias(k)
                   for k in names]).select(
        "rows", F.lit(len(fields)).cast("long").alias("columns"), "missing_cells",
        "duplicate_rows",
        F.round(F.col("bytes") / F.lit(1024.0 ** 2), 2).alias("memory_mb"),
        F.lit(kinds.count("numeric")).cast("long").alias("numeric_columns"),
        F.lit(kinds.count("string")).cast("long").alias("categorical_columns"),
        F.lit(kinds.count("boolean")).cast("long").alias("boolean_columns"),
        F.lit(kinds.count("datetime")).cast("long").alias("datetime_columns"),
    )


# ---------------------------------------------------------------------------
# per-column profile shared by type inference, target detection and health
# ---------------------------------------------------------------------------

def column_profile(df: DataFrame, columns=None, distinct: str = "categorical") -> DataFrame:
    """One row per column: pos, column, dtype, kind, rows, non_null, missing,
    unique, unique_with_null, avg_len, avg_len0, min, max, mean, std,
    is_constant.

    One global aggregate gives counts for every column and min/max/mean/std
    (as double) for numeric, boolean and datetime columns, and string lengths.
    Exact distinct counts come from the long-form frequency table (long strings
    as digests), built only for the columns that need it: ``distinct="categorical"`` (strings,
    booleans, nested) or ``"all"``.  ``unique`` is NULL for the others.
    ``is_constant`` is ``nunique(dropna=False) <= 1``: from the distinct count
    where known, else ``count = 0 ∨ (count = rows ∧ min = max)``.
    """
    fields = _fields(df, columns)
    if not fields:
        return _empty(df, "pos int, column string, dtype string, kind string, rows long, "
                          "non_null long, missing long, unique long, unique_with_null long, "
                          "avg_len double, avg_len0 double, min double, max double, "
                          "mean double, std double, is_constant boolean")
    kinds = [kind_of(f.dataType) for f in fields]
    ranged = [i for i, k in enumerate(kinds) if k in ("numeric", "boolean", "datetime")]
    if distinct == "all":
        freq_pos = list(range(len(fields)))
    else:
        freq_pos = [i for i, k in enumerate(kinds) if k not in ("numeric", "datetime")]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(~_is_missing(f)).alias(f"nn{i}"))
        if i in ranged:
            v = as_double(f.name, f.dataType)
            aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
            if kinds[i] != "datetime":
                aggs += [F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}")]
        if kinds[i] == "string":
            aggs.append(F.sum(F.length(col(f.name)).cast("double")).alias(f"ln{i}"))
    row = df.agg(*aggs)
    nd = F.lit(None).cast("double")
    base = _unpivot_row(row, [F.struct(
        F.lit(i).alias("pos"), F.col("__rows").cast("long").alias("rows"),
        F.col(f"nn{i}").cast("long").alias("non_null"),
        (F.col(f"mn{i}") if i in ranged else nd).alias("min"),
        (F.col(f"mx{i}") if i in ranged else nd).alias("max"),
        (F.col(f"av{i}") if i in ranged and kinds[i] != "datetime" else nd).alias("mean"),
        (F.col(f"sd{i}") if i in ranged and kinds[i] != "datetime" else nd).alias("std"),
        (F.col(f"ln{i}") if kinds[i] == "string" else nd).alias("__len"))
        for i in range(len(fields))])
    out = _names_df(df, fields).join(F.broadcast(base), "pos")
    if freq_pos:
        names = [fields[i].name for i in freq_pos]
        remap = F.create_map(*[x for j, i in enumerate(freq_pos) for x in (F.lit(j), F.lit(i))])
        freq = frequencies(df, names, digest=True)
        present = F.col("vl").isNotNull() | F.col("vd").isNotNull() | F.col("vs").isNotNull()
        counts = freq.groupBy("pos").agg(
            F.count_if(present).cast("long").alias("unique"),
            F.count(F.lit(1)).cast("long").alias("unique_with_null"))
        counts = counts.select(remap[F.col("pos")].alias("pos"), "unique", "unique_with_null")
        out = out.join(F.broadcast(counts), "pos", "left")
    else:
        out = out.select("*", F.lit(None).cast("long").alias("unique"),
                         F.lit(None).cast("long").alias("unique_with_null"))
    in_freq = F.col("pos").isin(*freq_pos) if freq_pos else F.lit(False)
    by_range = (F.col("non_null") == 0) | ((F.col("non_null") == F.col("rows")) & (F.col("min") == F.col("max")))
    is_const = F.when(in_freq, F.coalesce(F.col("unique_with_null"), F.lit(0)) <= 1).otherwise(by_range)
    return out.select(
        "pos", "column", "dtype", "kind", "rows", "non_null",
        (F.col("rows") - F.col("non_null")).alias("missing"),
        F.when(in_freq, F.coalesce("unique", F.lit(0))).cast("long").alias("unique"),
        F.when(in_freq, F.coalesce("unique_with_null", F.lit(0))).cast("long").alias("unique_with_null"),
        F.try_divide(F.col("__len"), F.col("non_null").cast("double")).alias("avg_len"),
        F.try_divide(F.coalesce(F.col("__len"), F.lit(0.0)), F.col("rows").cast("double")).alias("avg_len0"),
        "min", "max", "mean", "std", is_const.alias("is_constant"))
