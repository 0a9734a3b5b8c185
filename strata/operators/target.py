"""Target-column and problem-type detection.

Scores are CASE expressions over the per-column profile (one frequency shuffle
plus one moment aggregate for the whole table); only column names, which are
metadata, are scored on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import is_datetime, is_numeric_or_bool
from strata.operators.profile import column_profile

# Target keywords (a name equal to one scores +50, a name
# containing one +30, summed over all keywords).
TARGET_KEYWORDS = (
    "target", "label", "class", "outcome", "result", "prediction", "sales", "price",
    "profit", "income", "revenue", "quality", "species", "survived", "diagnosis",
    "default", "churn", "fraud", "score", "rating", "risk", "response", "y",
)

MIN_CONFIDENCE = 20.0
GOOD_CANDIDATE = 60.0


def normalise_name(name: str) -> str:
    return str(name).strip().lower().replace(" ", "_")


def keyword_score(name: str) -> float:
    n = normalise_name(name)
    return float(sum(50 if k == n else 30 for k in TARGET_KEYWORDS if k in n))


def position_score(index: int, total: int) -> float:
    return 0.0 if total <= 1 else index / (total - 1) * 15


def _meta(df: DataFrame) -> DataFrame:
    n = len(df.columns)
    rows = [(i, f.name, keyword_score(f.name), position_score(i, n),
             is_datetime(f.dataType), is_numeric_or_bool(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "pos int, column string, kw double, position double, is_dt boolean, is_num boolean")


def _ratio() -> Column:
    return F.col("unique") / F.greatest(F.col("rows"), F.lit(1)).cast("double")


def target_scores(df: DataFrame) -> DataFrame:
    """(pos, column, confidence, reason, problem_hint) for every column."""
    prof = column_profile(df, distinct="all").drop("column")
    t = _meta(df).join(F.broadcast(prof), "pos")
    u, ratio = F.col("unique"), _ratio()
    miss = F.try_divide(F.col("missing").cast("double"), F.col("rows").cast("double"))
    penalty = (F.when(miss >= 0.75, -30).when(miss >= 0.50, -20).when(miss >= 0.25, -10)
               .otherwise(0)).cast("double")
    cls = (F.when(u == 2, 40).when(u <= 5, 30).when(u <= 10, 20).when(u <= 20, 10).otherwise(0)
           + F.when(ratio < 0.10, 15).otherwise(0)
           + F.when(F.col("kind").isin("string", "boolean"), 10).otherwise(0)).cast("double")
    reg = F.when(~F.col("is_num"), 0).otherwise(
        F.when(ratio > 0.30, 25).otherwise(0) + F.when(u > 20, 20).otherwise(0)
        + F.when(F.coalesce(F.col("std") > 0, F.lit(False)), 10).otherwise(0)).cast("double")
    is_cls = cls >= reg
    raw = F.col("kw") + F.col("position") + penalty + F.when(is_cls, cls).otherwise(reg)
    score = F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2)
    reason = F.concat_ws(", ", F.array_compact(F.array(
        F.when(F.col("kw") > 0, F.lit("Target keyword")),
        F.when(F.col("position") >= 10, F.lit("Near end of dataset")),
        F.when(penalty != 0, F.lit("Missing value penalty")),
        F.when(is_cls, F.lit("Low-cardinality target")).otherwise(F.lit("Continuous numeric target")))))
    return t.select("pos", "column", score.alias("confidence"), reason.alias("reason"),
                    F.when(is_cls, "classification").otherwise("regression").alias("problem_hint"),
                    "is_dt")


def target_ranking(df: DataFrame, top_k: int = 5, minimum_confidence: float = MIN_CONFIDENCE,
                   good: float = GOOD_CANDIDATE) -> DataFrame:
    """Top-k candidates (rank, column, confidence, reason, problem_hint, is_good).

    Datetime columns are skipped; candidates below ``minimum_confidence`` are
    dropped unless none reaches it, then the top-k of all are returned.  Ties
    keep column order (a stable sort).
    """
    from pyspark.sql import Window
    from strata.operators.profile import fixed
    scores = fixed(target_scores(df).filter(~F.col("is_dt")))   # one row per column
    above = scores.filter(F.col("confidence") >= minimum_confidence)
    kept = above if above.limit(1).count() > 0 else scores
    top = kept.orderBy(F.desc("confidence"), F.asc("pos")).limit(top_k)
    # rank over the k kept rows only
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("confidence"), F.asc("pos"))).alias("rank"),
        "column", "confidence", "reason", "problem_hint",
        (F.col("confidence") >= good).alias("is_good"))


def suggested_target(df: DataFrame) -> dict | None:
    rows = target_ranking(df, top_k=1).collect()
    return rows[0].asDict() if rows else None


def suggested_problem(df: DataFrame) -> str:
    best = suggested_target(df)
    if best is None:
        numeric = sum(is_numeric_or_bool(f.dataType) for f in df.schema.fields)
        return "regression" if numeric >= len(df.columns) / 2 else "classification"
    return best["problem_hint"]


@dataclass
class ProblemDetection:
    problem_type: str
    confidence: float
    reason: str
    is_time_series: bool


TIME_SERIES_REASON = "Detected datetime feature(s) with a numeric target."
CLASSIFICATION_REASON = "Target has relatively few unique values and resembles class labels."
REGRESSION_REASON = "Target is continuous with sufficient numeric variation."


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """One row: problem_type, confidence, reason, is_time_series."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' does not exist.")
    fields = {f.name: f.dataType for f in df.schema.fields}
    time_series = any(is_datetime(t) for t in fields.values()) and is_numeric_or_bool(fields[target])
    prof = column_profile(df, [target], distinct="all")
    if time_series:
        return prof.select(F.lit("time_series").alias("problem_type"), F.lit(95.0).alias("confidence"),
                           F.lit(TIME_SERIES_REASON).alias("reason"), F.lit(True).alias("is_time_series"))
    u, ratio, k = F.col("unique"), _ratio(), F.col("kind")
    cls = (F.when(k == "boolean", 60).otherwise(0) + F.when(k == "string", 40).otherwise(0)
           + F.when(u == 2, 35).when(u <= 5, 25).when(u <= 10, 15).when(u <= 20, 8).otherwise(0)
           + F.when(ratio < 0.05, 20).when(ratio < 0.10, 10).otherwise(0)).cast("double")
    cls = F.least(cls, F.lit(100.0))
    if is_numeric_or_bool(fields[target]):
        reg = (F.when(u > 20, 30).otherwise(0) + F.when(ratio > 0.25, 35).otherwise(0)
               + F.when(F.coalesce(F.col("std") > 0, F.lit(False)), 20).otherwise(0)
               + F.when(F.coalesce(F.col("min") != F.col("max"), F.lit(True)), 15).otherwise(0)
               ).cast("double")
        reg = F.least(reg, F.lit(100.0))
    else:
        reg = F.lit(0.0)
    is_cls = cls >= reg
    return prof.select(
        F.when(is_cls, "classification").otherwise("regression").alias("problem_type"),
        F.round(F.when(is_cls, cls).otherwise(reg), 2).alias("confidence"),
        F.when(is_cls, CLASSIFICATION_REASON).otherwise(REGRESSION_REASON).alias("reason"),
        F.lit(False).alias("is_time_series"))


def detect_problem(df: DataFrame, target: str) -> ProblemDetection:
    r = problem_type(df, target).first()
    return ProblemDetection(r["problem_type"], float(r["confidence"]), r["reason"], bool(r["is_time_series"]))
