"""Registry of named queries over the driver's test tables.

Each entry maps a key to ``(callable(spark, sf_dir) -> DataFrame, oracle_sql)``;
``oracle_sql`` is DuckDB SQL over the same tables, or ``None`` where the result
is a fitted model and only a rows check applies.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_MODULES = ["profile_q", "types_q", "clean_q", "features_q", "encode_q", "io_q",
            "schema_q", "target_q", "evaluate_q", "charts_q", "models_q"]


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> dict:
    for m in _MODULES:
        importlib.import_module(f"strata.queries.{m}")
    return REGISTRY
