"""Feature-engineering plan: one min job (log/sqrt admissibility),
one ``select`` with every generated expression, one batched aggregate for
invalid columns, then the encodings."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import col, is_datetime, is_string
from strata.operators import clean as C
from strata.operators import encode as E
from strata.operators import features as FE

# Fixed value: the text of the warning.
LIMIT_WARNING = ("Numeric feature generation limited to the configured maximum number of "
                 "columns.")


@dataclass
class EngineerConfig:
    create_interactions: bool = True
    create_ratios: bool = True
    create_aggregates: bool = True
    create_polynomial: bool = False
    polynomial_degree: int = 2
    # None: all columns and all pairs; a number limits them and the report's warnings name what is left out
    max_numeric_features: int | None = None
    max_interaction_pairs: int | None = None
    drop_invalid_features: bool = True
    protect: tuple = ()


@dataclass
class EngineerReport:
    interaction_features: list[str] = field(default_factory=list)
    ratio_features: list[str] = field(default_factory=list)
    aggregate_features: list[str] = field(default_factory=list)
    removed_features: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"interaction_features": self.interaction_features,
                "ratio_features": self.ratio_features,
                "aggregate_features": self.aggregate_features,
                "removed_features": self.removed_features, "warnings": self.warnings}

    def generated(self) -> list[str]:
        return sorted(set(self.interaction_features + self.ratio_features + self.aggregate_features))


def engineer_numeric(df: DataFrame, config: EngineerConfig | None = None,
                     exclude=()) -> tuple[DataFrame, EngineerReport]:
    """All numeric generators over the numeric columns (the original ones, not
    generated ones), then invalid removal."""
    config = config or EngineerConfig()
    rep = EngineerReport()
    cols = FE.numeric_columns(df, exclude)
    if config.max_numeric_features is not None and len(cols) > config.max_numeric_features:
        rep.warnings += [LIMIT_WARNING, "Columns left out: " + ", ".join(cols[config.max_numeric_features:])]
        cols = cols[:config.max_numeric_features]
    pairs = len(cols) * (len(cols) - 1) // 2
    if config.max_interaction_pairs is not None and pairs > config.max_interaction_pairs \
            and (config.create_interactions or config.create_ratios):
        rep.warnings.append("Pairs left out: " + ", ".join(
            f"{a} and {b}" for a, b in list(combinations(cols, 2))[config.max_interaction_pairs:]))
    new = []
    if config.create_interactions:
        e = FE.interaction_exprs(cols, config.max_interaction_pairs)
        new += e
        rep.interaction_features += [n for n, _ in e]
    if config.create_ratios:
        e = FE.ratio_exprs(cols, config.max_interaction_pairs)
        new += e
        rep.ratio_features += [n for n, _ in e]
    row_aggs = config.create_aggregates and len(cols) >= 2
    if row_aggs:
        rep.aggregate_features += list(FE.ROW_AGGREGATES)
    if config.create_polynomial and cols:
        existing = set(df.columns) | {n for n, _ in new}
        e = FE.polynomial_exprs(cols, config.polynomial_degree, existing=existing)
        new += e
        rep.aggregate_features += [n for n, _ in e]
    mins = FE.column_minimums(df, cols)
    sq, cu, ab = FE.power_exprs(cols)
    for e in (FE.log_exprs(cols, mins), FE.sqrt_exprs(cols, mins), sq, cu, ab, FE.reciprocal_exprs(cols)):
        new += e
        rep.aggregate_features += [n for n, _ in e]
    # a later generator with an existing name replaces the column (pandas assignment)
    names = [n for n, _ in new]
    keep = [c for c in df.columns if c not in names and not (row_aggs and c in FE.ROW_AGGREGATES)]
    seen, exprs = set(), []
    for n, e in reversed(new):
        if n not in seen:
            seen.add(n)
            exprs.append((n, e))
    exprs.reverse()
    out = df.select(*[col(c) for c in keep], *[e.alias(n) for n, e in exprs])
    if row_aggs:
        # row aggregates sit after the interaction and ratio columns, as generated
        out, _ = FE.add_row_aggregates(out, cols)
        n_pairs = sum(1 for n in rep.interaction_features + rep.ratio_features if n in dict(exprs))
        gen = [n for n, _ in exprs]
        order = keep + gen[:n_pairs] + list(FE.ROW_AGGREGATES) + gen[n_pairs:]
        out = out.select(*[col(c) for c in order])
    if config.drop_invalid_features:
        out, removed = C.remove_invalid_features(out, protect=config.protect)
        rep.removed_features += removed
    return out, rep


def validate_engineered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop repeated column names (keep the first), then all-null columns."""
    from strata.operators.schema import drop_duplicate_columns
    return drop_duplicate_columns(df)


def engineer_features(df: DataFrame, config: EngineerConfig | None = None,
                      target: str | None = None) -> tuple[DataFrame, EngineerReport]:
    """numeric → date parts + cyclical → text lengths (every string column) →
    frequency and count encodings → validation."""
    config = config or EngineerConfig()
    exclude = [target] if target and target in df.columns else []
    data, rep = engineer_numeric(df, config, exclude)
    dts = [f.name for f in data.schema.fields if is_datetime(f.dataType)]
    if dts:
        new = FE.date_part_exprs(dts, with_time=False) + FE.cyclical_exprs(dts)
        data = data.select("*", *[e.alias(n) for n, e in new])
        rep.aggregate_features += [n for n, _ in new]
    strings = [f.name for f in data.schema.fields if is_string(f.dataType) and f.name not in exclude]
    if strings:
        data, created = FE.text_length_features(data, strings)
        rep.aggregate_features += created
        data, created = E.encode_counts(data, strings, frequency=True, count=True)
        # report order as generated: all frequency columns, then all count columns
        rep.aggregate_features += [n for n in created if n.endswith("_frequency")]
        rep.aggregate_features += [n for n in created if n.endswith("_count")]
        order = [c for c in data.columns if c not in created] + \
            [f"{c}_frequency" for c in strings] + [f"{c}_count" for c in strings]
        data = data.select(*[col(c) for c in order])
    data, removed = validate_engineered(data)
    rep.removed_features += removed
    return data, rep


# Metric names of the feature-engineering summary.
SUMMARY_METRICS = ("Interaction Features", "Ratio Features", "Aggregate Features",
                   "Removed Features", "Warnings")


def feature_report(spark, rep: EngineerReport) -> DataFrame:
    """(Metric, Value) counts of the report."""
    vals = [len(rep.interaction_features), len(rep.ratio_features), len(rep.aggregate_features),
            len(rep.removed_features), len(rep.warnings)]
    return spark.createDataFrame(list(zip(SUMMARY_METRICS, vals)), "Metric string, Value long")
