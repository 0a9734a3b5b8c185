"""Dataset health, quality issues and the composite profiles.

A table profile row is assembled from jobs on the input: a plain aggregate
(rows, missing cells, bytes), a grouping of row keys (duplicates), the per-column
constant aggregate and the long-form frequency count (distinct values of
string columns).  The partial results are unioned as (metric, value) rows and
pivoted by one aggregate, so no join between them is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import col, is_string
from strata.operators import profile as P

HIGH_CARD_INSPECT = 50
HIGH_CARD_EDA = 100


def _metric_rows(df: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    parts = [P.scan_metrics(df)]
    # per-column facts from the column profile (one frequency shuffle, shared)
    prof = prof if prof is not None else P.column_profile(df)
    is_str = F.col("kind") == "string"
    per_col = prof.agg(
        F.count_if(F.col("is_constant")).cast("double").alias("constant_columns"),
        F.count_if(F.col("missing") > 0).cast("double").alias("columns_with_missing"),
        F.count_if(is_str & (F.col("unique") >= HIGH_CARD_INSPECT)).cast("double").alias("high_card_50"),
        F.count_if(is_str & (F.col("unique") >= HIGH_CARD_EDA)).cast("double").alias("high_card_100"))
    parts.append(per_col.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("constant_columns", "columns_with_missing", "high_card_50", "high_card_100")]))))
    return reduce(DataFrame.unionByName, parts)


def table_profile(df: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    """One row: rows, columns, duplicate_rows, missing_cells, bytes,
    constant_columns, columns_with_missing, high_card_50, high_card_100.

    Two jobs on the input: the group-by over all columns and the column
    profile (pass ``prof`` to share an already computed one)."""
    m = _metric_rows(df, prof)
    names = ["rows", "duplicate_rows", "missing_cells", "bytes", "constant_columns",
             "columns_with_missing", "high_card_50", "high_card_100"]
    return m.agg(*[F.coalesce(F.max(F.when(F.col("metric") == k, F.col("value"))), F.lit(0.0))
                   .alias(k) for k in names]).select(
        F.col("rows").cast("long").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
        *[F.col(k).cast("long").alias(k) for k in names[1:]])


def health_score(df: DataFrame) -> DataFrame:
    """One row (health_score): 100 − 40·null share − 20·duplicate share
    − 20·constant share − 20·high-cardinality share (50), floor 0, round 2."""
    p = table_profile(df)
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1)).cast("double")
    ncols = F.greatest(F.col("columns"), F.lit(1)).cast("double")
    s = (F.lit(100.0) - F.col("missing_cells") / cells * 40
         - F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)).cast("double") * 20
         - F.col("constant_columns") / ncols * 20 - F.col("high_card_50") / ncols * 20)
    return p.select(F.round(F.greatest(s, F.lit(0.0)), 2).alias("health_score"))


# Health messages.
MSG_HIGH_MISSING = "High proportion of missing values."
REC_HIGH_MISSING = "Consider imputing missing values."
MSG_DUPLICATES = "{} duplicate rows detected."
REC_DUPLICATES = "Remove duplicate observations."
MSG_CONSTANT = "Constant-value columns detected."
REC_CONSTANT = "Remove constant features."
MSG_HIGH_CARD = "High-cardinality categorical columns found."
REC_HIGH_CARD = "Consider frequency encoding or removal."


def health_report(df: DataFrame) -> DataFrame:
    """One row: score (round 1), warnings, recommendations (EDA rules)."""
    p = table_profile(df)
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1)).cast("double")
    high_missing = F.col("missing_cells") / cells > 0.20
    dups = F.col("duplicate_rows") > 0
    consts = F.col("constant_columns") > 0
    hc = F.col("high_card_100") > 0
    score = (F.lit(100.0) - F.when(high_missing, 20).otherwise(0) - F.when(dups, 10).otherwise(0)
             - F.when(consts, 5).otherwise(0) - F.when(hc, 5).otherwise(0))
    warnings = F.array_compact(F.array(
        F.when(high_missing, F.lit(MSG_HIGH_MISSING)),
        F.when(dups, F.format_string(MSG_DUPLICATES.replace("{}", "%d"), F.col("duplicate_rows"))),
        F.when(consts, F.lit(MSG_CONSTANT)), F.when(hc, F.lit(MSG_HIGH_CARD))))
    recs = F.array_compact(F.array(
        F.when(high_missing, F.lit(REC_HIGH_MISSING)), F.when(dups, F.lit(REC_DUPLICATES)),
        F.when(consts, F.lit(REC_CONSTANT)), F.when(hc, F.lit(REC_HIGH_CARD))))
    return p.select(F.round(F.greatest(score, F.lit(0.0)), 1).alias("score"),
                    warnings.alias("warnings"), recs.alias("recommendations"))


def quality_issues(df: DataFrame) -> DataFrame:
    """(seq, issue): duplicate, constant, missing and high-cardinality messages."""
    p = table_profile(df)
    items = F.array_compact(F.array(
        F.when(F.col("duplicate_rows") > 0, F.format_string("%d duplicate rows detected.", "duplicate_rows")),
        F.when(F.col("constant_columns") > 0,
               F.format_string("%d constant-value columns detected.", "constant_columns")),
        F.when(F.col("columns_with_missing") > 0,
               F.format_string("%d columns contain missing values.", "columns_with_missing")),
        F.when(F.col("high_card_50") > 0,
               F.format_string("%d high-cardinality columns detected.", "high_card_50"))))
    return p.select(F.posexplode(items).alias("seq", "issue"))


def _kind_counts(df: DataFrame, groups: DataFrame) -> DataFrame:
    return groups.agg(*[F.count_if(F.col("feature_group") == g).cast("long").alias(f"{g}_features")
                        for g in ("numeric", "categorical", "boolean", "datetime", "text")])


def inspect_dataset(df: DataFrame) -> DataFrame:
    """One row of the inspector profile (thresholds 50 / ratio ≥ .70): rows,
    columns, duplicate_rows, constant_columns, high_cardinality_columns,
    memory_mb, health_score and the number of columns per group (text columns
    also count as categorical, as in the inspector)."""
    from strata.operators.types import feature_groups
    prof = P.fixed(P.column_profile(df))
    p = table_profile(df, prof)
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1)).cast("double")
    ncols = F.greatest(F.col("columns"), F.lit(1)).cast("double")
    s = (F.lit(100.0) - F.col("missing_cells") / cells * 40
         - F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)).cast("double") * 20
         - F.col("constant_columns") / ncols * 20 - F.col("high_card_50") / ncols * 20)
    groups = feature_groups(df, profile=prof)
    counts = groups.agg(
        F.count_if(F.col("feature_group") == "numeric").alias("numeric_features"),
        F.count_if(F.col("feature_group").isin("categorical", "text")).alias("categorical_features"),
        F.count_if(F.col("feature_group") == "boolean").alias("boolean_features"),
        F.count_if(F.col("feature_group") == "datetime").alias("datetime_features"),
        F.count_if(F.col("feature_group") == "text").alias("text_features"))
    stats = p.select("rows", "columns", "duplicate_rows", "constant_columns",
                     F.col("high_card_50").alias("high_cardinality_columns"),
                     F.round(F.col("bytes") / F.lit(1024.0 ** 2), 2).alias("memory_mb"),
                     F.round(F.greatest(s, F.lit(0.0)), 2).alias("health_score"))
    return _side_by_side(stats, counts)


def summarize_dataset(df: DataFrame) -> DataFrame:
    """One row of the EDA summary (thresholds 100 / ratio > .70 or length > 25)."""
    from strata.operators.types import feature_types_eda
    prof = P.fixed(P.column_profile(df))
    p = table_profile(df, prof)
    counts = feature_types_eda(df, profile=prof).agg(
        *[F.count_if(F.col("feature_group") == g).alias(f"{g}_features")
          for g in ("numeric", "categorical", "boolean", "datetime", "text")])
    stats = p.select("rows", "columns", "missing_cells", "duplicate_rows", "constant_columns",
                     F.col("high_card_100").alias("high_cardinality_columns"),
                     F.round(F.col("bytes") / F.lit(1024.0 ** 2), 2).alias("memory_mb"))
    return _side_by_side(stats, counts)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two one-row frames by union + aggregate (no join)."""
    ca, cb = a.columns, b.columns
    nulls_a = [F.lit(None).cast(a.schema[c].dataType).alias(c) for c in ca]
    nulls_b = [F.lit(None).cast(b.schema[c].dataType).alias(c) for c in cb]
    u = a.select(*[F.col(c) for c in ca], *nulls_b).unionByName(
        b.select(*nulls_a, *[F.col(c) for c in cb]))
    return u.agg(*[F.max(c).alias(c) for c in ca + cb])


def eda_report(df: DataFrame) -> dict[str, DataFrame]:
    """The EDA sections as DataFrames."""
    return {
        "summary": summarize_dataset(df),
        "health": health_report(df),
        "missing": P.missing_summary(df),
        "duplicates": P.duplicate_rows(df),
        "statistics": P.describe(df),
        "correlation": P.correlation(df, min_columns=1),
    }
