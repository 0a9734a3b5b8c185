"""Preprocessing plan: the cleaning steps in the reference's order, the
(before, after) report, and the ML preprocessing pipeline (SURVEY §2.6, §2.8)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import col
from strata.operators import clean as C
from strata.operators import encode as E
from strata.operators import features as FE
from strata.operators import profile as P
from strata.operators.types import feature_groups


@dataclass
class FeatureGroups:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def detect_groups(df: DataFrame, target: str | None = None, text_ratio: float = 0.70) -> FeatureGroups:
    """Feature groups in column order (one profile job, O(columns) collected)."""
    rows = {r["column"]: r["feature_group"]
            for r in feature_groups(df, target, text_ratio).collect()}
    g = FeatureGroups()
    for c in df.columns:
        if c in rows:
            getattr(g, rows[c]).append(c)
    return g


@dataclass
class PreprocessConfig:
    numeric_missing_strategy: str = "median"
    categorical_missing_strategy: str = "most_frequent"
    remove_duplicates: bool = True
    drop_constant_columns: bool = True
    one_hot_encode: bool = True
    scale_numeric: bool = True
    scaler: str = "standard"
    parse_dates: bool = True
    extract_date_parts: bool = True
    detect_text: bool = True
    remove_outliers: bool = False
    outlier_method: str = "iqr"
    keep_text: bool = False
    approx_quantiles: bool = False
    materialize: bool = True


def preprocess(df: DataFrame, config: PreprocessConfig | None = None,
               target: str | None = None) -> tuple[DataFrame, dict]:
    """dedup → constant → high-missing → high-cardinality → groups → impute →
    date parts → text clean → (outliers) → report.

    The deduplicated rows are materialised once (``checkpoint`` to the shared
    folder) so the later decision jobs do not repeat the dedup shuffle.  All
    four column decisions and the feature groups come from ONE column profile
    (per-column statistics are independent of the other columns, so applying
    the drops in sequence to these numbers equals re-profiling after each
    drop); imputation needs one quantile job and one mode job."""
    config = config or PreprocessConfig()
    if target is not None and target not in df.columns:
        raise ValueError(f"Target column '{target}' not found.")
    original, data = df, df
    meta: dict = {"removed_duplicates": 0, "removed_constant_columns": [],
                  "removed_high_missing_columns": [], "removed_high_cardinality_columns": [],
                  "text_columns": [], "datetime_columns": [], "feature_groups": None}
    if config.remove_duplicates:
        data = C.drop_duplicates(data)
        if config.materialize:
            from strata.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(data.sparkSession)
            data = data.checkpoint(eager=True)
        meta["removed_duplicates"] = df.count() - data.count()
    prof = {r["column"]: r for r in P.column_profile(data).collect()}   # one row per column
    cols = [c for c in data.columns if c != target]
    if config.drop_constant_columns:
        meta["removed_constant_columns"] = [c for c in cols if prof[c]["is_constant"]]
    gone = set(meta["removed_constant_columns"])
    meta["removed_high_missing_columns"] = [
        c for c in cols if c not in gone and prof[c]["rows"] > 0
        and prof[c]["missing"] / prof[c]["rows"] >= C.HIGH_MISSING]
    gone |= set(meta["removed_high_missing_columns"])
    if not config.keep_text:
        meta["removed_high_cardinality_columns"] = [
            c for c in cols if c not in gone and prof[c]["kind"] == "string"
            and (prof[c]["unique"] or 0) >= C.HIGH_CARDINALITY]
    gone |= set(meta["removed_high_cardinality_columns"])
    data = data.drop(*[c for c in data.columns if c in gone])
    groups = FeatureGroups()
    for c in data.columns:
        if c == target:
            continue
        k = prof[c]["kind"]
        if k == "string":
            ratio = (prof[c]["unique"] or 0) / prof[c]["rows"] if prof[c]["rows"] else 0.0
            (groups.text if ratio >= 0.70 else groups.categorical).append(c)
        elif k in ("numeric", "boolean", "datetime"):
            getattr(groups, k).append(c)
    meta["feature_groups"] = groups
    meta["text_columns"] = groups.text
    meta["datetime_columns"] = groups.datetime
    plan = C.fill_plan(data, groups.numeric, groups.categorical, groups.boolean,
                       config.numeric_missing_strategy, config.categorical_missing_strategy,
                       config.approx_quantiles)
    data = C.apply_fill(data, plan)
    if config.parse_dates and config.extract_date_parts and groups.datetime:
        data, _ = FE.date_part_features(data, groups.datetime, with_time=True)
    if config.detect_text and groups.text:
        data = FE.clean_text_columns(data, groups.text)
    if config.remove_outliers:
        g2 = detect_groups(data, target)
        data = C.remove_outliers(data, g2.numeric, config.outlier_method,
                                 approx=config.approx_quantiles)
    meta["report"] = preprocess_report(original, data)
    return data, meta


def preprocess_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: original/processed rows and columns, rows removed, missing
    cells before and after."""
    def part(df, prefix):
        row, fields = P.null_counts_row(df)
        total = F.lit(0).cast("long")
        for i in range(len(fields)):
            total = total + F.col(f"m{i}").cast("long")
        return row.select(F.col("__rows").cast("long").alias(f"{prefix}_rows"),
                          total.alias(f"missing_{'before' if prefix == 'original' else 'after'}"))
    b, a = part(before, "original"), part(after, "processed")
    from strata.operators.health import _side_by_side
    both = _side_by_side(b, a)
    return both.select("original_rows", "processed_rows",
                       (F.col("original_rows") - F.col("processed_rows")).alias("rows_removed"),
                       F.lit(len(before.columns)).cast("long").alias("original_columns"),
                       F.lit(len(after.columns)).cast("long").alias("processed_columns"),
                       "missing_before", "missing_after")


# Step names of the preprocessing summary.
SUMMARY_STEPS = ("Duplicate Rows Removed", "Constant Columns Removed", "High Missing Columns Removed",
                 "High Cardinality Columns Removed", "Detected Datetime Columns", "Detected Text Columns")


def preprocess_summary(meta: dict, before: DataFrame, after_dedup: DataFrame | None = None) -> DataFrame:
    """(Step, Value) rows of the preprocessing metadata.  The duplicate count is
    computed as a Spark job (rows before − distinct rows)."""
    spark = before.sparkSession
    counts = [len(meta.get("removed_constant_columns", [])),
              len(meta.get("removed_high_missing_columns", [])),
              len(meta.get("removed_high_cardinality_columns", [])),
              len(meta.get("datetime_columns", [])), len(meta.get("text_columns", []))]
    dups = P.duplicate_rows(before).select(
        F.lit(SUMMARY_STEPS[0]).alias("Step"), F.col("duplicate_rows").alias("Value"))
    rest = spark.createDataFrame([(s, int(v)) for s, v in zip(SUMMARY_STEPS[1:], counts)],
                                 "Step string, Value long")
    return dups.unionByName(rest)


# ---------------------------------------------------------------------------
# ML preprocessing pipeline
# ---------------------------------------------------------------------------

def build_preprocessor(df: DataFrame, config: PreprocessConfig | None = None,
                       target: str | None = None, features_col: str = "features"):
    """Unfitted ``Pipeline``: numeric impute + scale, categorical impute +
    one-hot (alphabetical, unseen → zeros) or ordinal (unseen → −1), booleans
    passed through; text and datetime columns are dropped.  Returns
    (pipeline, groups, assembled input names)."""
    config = config or PreprocessConfig()
    g = detect_groups(df, target)
    stages, assembled = [], []
    if g.numeric:
        stages.append(E.imputer(g.numeric, config.numeric_missing_strategy, config.approx_quantiles))
        if config.scale_numeric:
            stages.append(E.scaler(g.numeric, config.scaler, approx=config.approx_quantiles))
        assembled += g.numeric
    if g.categorical:
        stages.append(E.imputer(g.categorical, config.categorical_missing_strategy))
        idx = [f"{c}__idx" for c in g.categorical]
        stages.append(StringIndexer(inputCols=g.categorical, outputCols=idx,
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        if config.one_hot_encode:
            ohe = [f"{c}__ohe" for c in g.categorical]
            stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True,
                                        handleInvalid="keep"))
            assembled += ohe
        else:
            assembled += idx
    if g.boolean:
        from strata.operators.encode import ColumnStatsEstimator
        stages.append(ColumnStatsEstimator(inputCols=g.boolean, outputCols=[f"{c}__num" for c in g.boolean],
                                           method="constant"))
        assembled += [f"{c}__num" for c in g.boolean]
    stages.append(VectorAssembler(inputCols=assembled, outputCol=features_col, handleInvalid="keep"))
    return Pipeline(stages=stages), g, assembled


def transformed_feature_names(model, df: DataFrame, features_col: str = "features") -> list[str]:
    """Output feature names from the assembled vector's ML attributes
    (``col_value`` for one-hot slots); [] when unavailable."""
    try:
        out = model.transform(df.limit(0))
        meta = out.schema[features_col].metadata.get("ml_attr", {}).get("attrs", {})
        slots = sorted([a for group in meta.values() for a in group], key=lambda a: a["idx"])
        names = []
        for a in slots:
            n = a["name"]
            for suffix in ("__ohe_", "__idx_", "__num_"):
                n = n.replace(suffix, "_")
            names.append(n.replace("__num", "").replace("__idx", ""))
        return names
    except Exception:  # noqa: BLE001
        return []


def validate_pipeline(pipeline: Pipeline, df: DataFrame) -> bool:
    try:
        pipeline.fit(df)
        return True
    except Exception:  # noqa: BLE001
        return False


def prepare_training(df: DataFrame, target: str, config: PreprocessConfig | None = None):
    """preprocess → (data, feature columns, target, unfitted pipeline, metadata)."""
    data, meta = preprocess(df, config, target)
    pipe, groups, _ = build_preprocessor(data, config, target)
    feats = [c for c in data.columns if c != target]
    return data, feats, target, pipe, meta
