"""Encodings, scalers and imputers.

Fitted transforms are ``pyspark.ml`` Estimators whose fit is one aggregate job
and whose model is a projection; they persist with a ``Pipeline``.  Frequency
and count encodings are a grouped count joined back to the rows: broadcast when
the number of distinct values is proven small, a shuffle join (AQE handles a
hot key) otherwise.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import as_double, col

# ---------------------------------------------------------------------------
# frequency / count encoding
# ---------------------------------------------------------------------------

#: parts a hot value's rows are dealt to, and the share of rows from which a value is hot
HOT_PARTS, HOT_SHARE = 64, 1 / 256
#: values of a column up to which its counts go to every executor, so that no row moves (2 MB of short keys at most)
FEW_VALUES = 10_000


def encode_counts(df: DataFrame, columns, frequency: bool = True, count: bool = True) -> tuple[DataFrame, list[str]]:
    """Value counts joined back to the rows, one grouped count and one join per
    column serving both encodings: ``c_frequency`` (double, NULL is a value of
    its own) and ``c_count`` (long, NULL for a NULL value).

    Long strings are grouped and joined by digest.  The counts of a column with at
    most ``FEW_VALUES`` values are broadcast (unless the session forbids broadcasts):
    left to itself, Spark has shuffled the rows before it knows how few values there
    are.  For others it chooses the join at run time.  Where it shuffles, rows of a value
    that holds more than ``HOT_SHARE`` of the table are dealt to ``HOT_PARTS``
    parts, with the value's count copied to each, so no hot value is one task."""
    from strata.operators.profile import short_key
    if not columns or not (frequency or count):
        return df, []
    # equal rows get different parts; whichever part a row is in, it meets the same count
    out, created = df.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS)).cast("int")), []
    dtypes = {f.name: f.dataType for f in df.schema.fields}

    def text(c: Column) -> Column:
        return short_key(c.cast("string"))

    total = df.count()
    values = df.select(F.inline(F.array(*[F.struct(F.lit(j).alias("j"), text(col(c)).alias("v"))
                                          for j, c in enumerate(columns)])))
    # per column its number of values, and the hot ones: at most 1 / HOT_SHARE
    found = values.groupBy("j", "v").count().groupBy("j").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("count") > total * HOT_SHARE, F.struct("v"))).alias("hot")).collect()
    may_broadcast = not df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    few = {r["j"] for r in found if may_broadcast and r["n"] <= FEW_VALUES}
    hot: dict[int, list] = {r["j"]: [h["v"] for h in r["hot"]] for r in found}

    def is_hot(j: int, k: Column) -> Column:
        found = F.coalesce(k.isin(*[v for v in hot.get(j, []) if v is not None]), F.lit(False))
        return found | k.isNull() if None in hot.get(j, []) else found

    for j, c in enumerate(columns):
        key, n, salt = f"__k_{j}", f"__n_{j}", f"__s_{j}"
        is_text = isinstance(dtypes[c], T.StringType)
        value = short_key(col(c)) if is_text else col(c)
        counts = df.groupBy(value.alias(key)).agg(F.count(F.lit(1)).alias(n))
        of_key = F.col(key) if is_text else text(F.col(key))
        if j in few:
            out = out.join(F.broadcast(counts), value.eqNullSafe(F.col(key)), "left").drop(key)
        else:
            counts = counts.withColumn(salt, F.explode(
                F.when(is_hot(j, of_key), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
            row_salt = F.when(is_hot(j, text(col(c))), F.col("__part")).otherwise(0)
            out = out.join(counts, value.eqNullSafe(F.col(key)) & (row_salt == F.col(salt)), "left").drop(key, salt)
        new = []
        if frequency:
            new.append(F.col(n).cast("double").alias(f"{c}_frequency"))
        if count:
            new.append(F.when(col(c).isNotNull(), F.col(n)).cast("long").alias(f"{c}_count"))
        out = out.select(*[F.col(f"`{x}`") for x in out.columns if x != n], *new)
        created += [f"{c}_frequency"] * frequency + [f"{c}_count"] * count
    return out.drop("__part"), created


def frequency_encode(df: DataFrame, columns):
    """``c_frequency``: number of rows holding the row's value (double); NULL is
    a value of its own."""
    return encode_counts(df, columns, frequency=True, count=False)


def count_encode(df: DataFrame, columns):
    """``c_count``: as frequency but a NULL value gets NULL (long)."""
    return encode_counts(df, columns, frequency=False, count=True)


# ---------------------------------------------------------------------------
# categories: one-hot and ordinal as columns
# ---------------------------------------------------------------------------

#: categories of one column that may be named on the driver, unless the caller says otherwise
MAX_CATEGORIES = 10_000


def categories(df: DataFrame, columns, max_categories: int | None = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column from one grouped job.

    The values go to the driver and become columns or literals, so they are counted first
    and a column with more than ``max_categories`` raises ``ValueError`` (use frequency
    encoding for it); ``None`` lifts the bound."""
    if not columns:
        return {}
    from strata.operators.profile import frequencies
    freq = frequencies(df, columns).filter(F.col("vs").isNotNull() | F.col("vl").isNotNull()
                                           | F.col("vd").isNotNull())
    counts = {r["pos"]: r["k"] for r in freq.groupBy("pos").agg(F.count(F.lit(1)).alias("k")).collect()}
    for i, c in enumerate(columns):
        if max_categories is not None and counts.get(i, 0) > max_categories:
            raise ValueError(f"column {c} has {counts[i]} categories (limit {max_categories})")
    vals = freq.select("pos", F.coalesce(F.col("vs"), F.col("vl").cast("string"),
                                         F.col("vd").cast("string")).alias("v")).collect()
    out = {c: [] for c in columns}
    for r in vals:
        out[columns[r["pos"]]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_columns(df: DataFrame, columns, cats: dict | None = None, drop_input: bool = True):
    """Dense indicator columns ``c_value`` (double) over the sorted categories;
    unseen and NULL values give all zeros."""
    cats = cats if cats is not None else categories(df, columns)
    keep = [col(c) for c in df.columns if not (drop_input and c in columns)]
    new, names = [], []
    for c in columns:
        for v in cats[c]:
            n = f"{c}_{v}"
            new.append(F.when(col(c).cast("string") == F.lit(v), 1.0).otherwise(0.0).alias(n))
            names.append(n)
    return df.select(*keep, *new), names


def ordinal_columns(df: DataFrame, columns, cats: dict | None = None):
    """Index of the value in the sorted categories (double); unseen or NULL → −1."""
    cats = cats if cats is not None else categories(df, columns)
    out = []
    for c in df.columns:
        if c in columns:
            m = F.create_map(*[x for i, v in enumerate(cats[c]) for x in (F.lit(v), F.lit(float(i)))]) \
                if cats[c] else None
            e = F.coalesce(m[col(c).cast("string")], F.lit(-1.0)) if m is not None else F.lit(-1.0)
            out.append(e.alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


# ---------------------------------------------------------------------------
# fitted per-column statistics as ML stages
# ---------------------------------------------------------------------------

class _StatsParams(HasInputCols, HasOutputCols):
    method = Param(Params._dummy(), "method", "standard | minmax | robust | median | mean | "
                   "most_frequent | constant", typeConverter=TypeConverters.toString)
    stats = Param(Params._dummy(), "stats", "fitted statistics (JSON)", typeConverter=TypeConverters.toString)
    approx = Param(Params._dummy(), "approx", "approximate quantiles", typeConverter=TypeConverters.toBoolean)

    def _outs(self):
        if self.isSet(self.outputCols):
            return self.getOutputCols()
        return self.getInputCols()


class ColumnStatsModel(Model, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    """Applies fitted per-column statistics as one projection."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, method=None, stats=None, approx=False):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _expr(self, c: str, dt) -> Column:
        m = self.getOrDefault(self.method)
        st = json.loads(self.getOrDefault(self.stats))[c]
        if m in ("standard", "minmax", "robust"):
            v = as_double(c, dt)
            if st["center"] is None:
                return v
            return (v - F.lit(st["center"])) / F.lit(st["scale"])
        if st.get("kind") == "string":
            return col(c) if st["fill"] is None else F.coalesce(col(c), F.lit(st["fill"]))
        if st.get("kind") == "boolean":
            return col(c) if st["fill"] is None else F.coalesce(col(c), F.lit(bool(st["fill"])))
        v = as_double(c, dt)
        return v if st["fill"] is None else F.coalesce(v, F.lit(float(st["fill"])))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ins, outs = self.getInputCols(), self._outs()
        dtypes = {f.name: f.dataType for f in dataset.schema.fields}
        mapping = {o: self._expr(i, dtypes[i]) for i, o in zip(ins, outs)}
        exprs = [mapping.pop(c).alias(c) if c in mapping else col(c) for c in dataset.columns]
        exprs += [e.alias(o) for o, e in mapping.items()]
        return dataset.select(*exprs)


class ColumnStatsEstimator(Estimator, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    """Scaler / imputer fitted by one aggregate.

    Scalers: standard (population deviation), minmax, robust (median, IQR with
    exact quantiles); a zero spread divides by 1.  Imputers: median (exact),
    mean, most_frequent (smallest on ties), constant (0 / 'missing_value').
    """

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, method="standard", approx=False):
        super().__init__()
        self._setDefault(method="standard", approx=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ColumnStatsModel:
        m = self.getOrDefault(self.method)
        ins = self.getInputCols()
        approx = self.getOrDefault(self.approx)
        dtypes = {f.name: f.dataType for f in dataset.schema.fields}
        stats = {}
        if m == "most_frequent":
            from strata.operators.profile import modes
            from strata.functions.columns import kind_of
            top = {r["column"]: r for r in modes(dataset, ins).collect()}
            for c in ins:
                r, kind = top.get(c), kind_of(dtypes[c])
                if kind == "string":
                    stats[c] = {"fill": None if r is None else r["top"], "kind": kind}
                elif kind == "boolean":
                    stats[c] = {"fill": None if r is None or r["top"] is None else r["top"] == "true",
                                "kind": kind}
                else:
                    v = None if r is None else (r["top_d"] if r["top_d"] is not None else r["top_l"])
                    stats[c] = {"fill": None if v is None else float(v), "kind": kind}
        elif m == "constant":
            for c in ins:
                text = isinstance(dtypes[c], T.StringType)
                stats[c] = {"fill": "missing_value", "kind": "string"} if text else {"fill": 0.0}
        else:
            aggs, qs = [F.lit(1).alias("__one")], {}
            if m in ("median", "robust"):
                from strata.operators.quantiles import quantiles
                qs = quantiles(dataset, list(ins), [0.25, 0.5, 0.75], "approx" if approx else "exact")
            for i, c in enumerate(ins):
                v = as_double(c, dtypes[c])
                if m in ("median", "robust"):
                    pass
                elif m == "minmax":
                    aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
                else:
                    aggs += [F.avg(v).alias(f"mu{i}"), F.stddev_pop(v).alias(f"sd{i}")]
            row = dataset.agg(*aggs).first() if len(aggs) > 1 else None
            for i, c in enumerate(ins):
                if m == "median":
                    q = qs.get(c)
                    stats[c] = {"fill": None if q is None else q[1]}
                elif m == "mean":
                    stats[c] = {"fill": row[f"mu{i}"]}
                elif m == "robust":
                    q = qs.get(c)
                    if q is None or q[1] is None:
                        stats[c] = {"center": None, "scale": None}
                    else:
                        iqr = q[2] - q[0]
                        stats[c] = {"center": q[1], "scale": iqr if iqr != 0 else 1.0}
                elif m == "minmax":
                    lo, hi = row[f"lo{i}"], row[f"hi{i}"]
                    if lo is None:
                        stats[c] = {"center": None, "scale": None}
                    else:
                        stats[c] = {"center": lo, "scale": (hi - lo) if hi != lo else 1.0}
                else:
                    mu, sd = row[f"mu{i}"], row[f"sd{i}"]
                    if mu is None:
                        stats[c] = {"center": None, "scale": None}
                    else:
                        stats[c] = {"center": mu, "scale": sd if sd else 1.0}
        model = ColumnStatsModel(inputCols=ins, method=m, stats=json.dumps(stats))
        if self.isSet(self.outputCols):
            model._set(outputCols=self.getOutputCols())
        return model


def scaler(columns, method: str = "standard", output_cols=None, approx=False) -> ColumnStatsEstimator:
    """standard / minmax / robust; any other name falls back to standard."""
    method = method.lower()
    if method not in ("standard", "minmax", "robust"):
        method = "standard"
    est = ColumnStatsEstimator(inputCols=list(columns), method=method, approx=approx)
    if output_cols:
        est._set(outputCols=list(output_cols))
    return est


def imputer(columns, strategy: str = "median", approx=False) -> ColumnStatsEstimator:
    return ColumnStatsEstimator(inputCols=list(columns), method=strategy, approx=approx)


def scale(df: DataFrame, columns, method: str = "standard") -> DataFrame:
    """Fit and apply a scaler in place."""
    return scaler(columns, method).fit(df).transform(df)
