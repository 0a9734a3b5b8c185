"""Writers: tables by suffix, report JSON, metrics tables, models, the export
folder and its manifest (SURVEY §2.2).  Every write is a distributed Spark
write; nothing is packed on the driver."""

from __future__ import annotations

import json
import os
import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.readers import CSV_OPTIONS, extension

WRITE_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}
# a null is an empty cell, an empty string a quoted one; blanks at the ends of a cell stay
CSV_WRITE_OPTIONS = dict(CSV_OPTIONS, emptyValue='""', nullValue="", timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS",
                         timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", dateFormat="yyyy-MM-dd")


def save_table(df: DataFrame | None, path: str, mode: str = "overwrite") -> str:
    """Write by suffix (CSV with header, UTF-8; parquet; JSON; ORC)."""
    if df is None:
        raise ValueError("No dataframe to save.")
    ext = extension(path)
    if ext not in WRITE_FORMATS:
        raise ValueError(f"Unsupported export format '{ext}'.")
    w = df.write.mode(mode)
    if ext == ".csv":
        w = w.options(**CSV_WRITE_OPTIONS)
    w.format(WRITE_FORMATS[ext]).save(path)
    return path


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row (values that JSON lacks are rendered by Spark)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def save_json(spark: SparkSession, report, path: str) -> str:
    """Write a report: a DataFrame as JSON lines, or a small dict (a report
    record, bounded by its fields) as one JSON document."""
    if isinstance(report, DataFrame):
        report.write.mode("overwrite").json(path)
        return path
    if report is None:
        raise ValueError("No report to save.")
    doc = json.dumps(report, default=str)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def metrics_table(metrics) -> DataFrame:
    """(Metric, Value) rows from a one-row metrics DataFrame."""
    cols = [c for c in metrics.columns]
    num = metrics.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return num.unpivot([], cols, "Metric", "Value")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# Member names of an export folder.
EXPORT_MEMBERS = {"cleaned": "cleaned_dataset.csv", "predictions": "predictions.csv",
                  "metrics_json": "metrics.json", "metrics_csv": "metrics.csv", "model": "model",
                  "charts": "charts"}


def export_project(spark: SparkSession, folder: str, cleaned: DataFrame | None = None,
                   predictions: DataFrame | None = None, metrics: DataFrame | None = None,
                   model: PipelineModel | None = None, charts: dict | None = None) -> list[str]:
    """One folder with cleaned_dataset.csv, predictions.csv, metrics.json,
    metrics.csv, model and chart data; absent parts are skipped.  Each member
    is a Spark write (a directory of part files)."""
    written = []
    if cleaned is not None:
        written.append(save_table(cleaned, os.path.join(folder, EXPORT_MEMBERS["cleaned"])))
    if predictions is not None:
        written.append(save_table(predictions, os.path.join(folder, EXPORT_MEMBERS["predictions"])))
    if metrics is not None:
        written.append(save_json(spark, metrics, os.path.join(folder, EXPORT_MEMBERS["metrics_json"])))
        written.append(save_table(metrics_table(metrics), os.path.join(folder, EXPORT_MEMBERS["metrics_csv"])))
    if model is not None:
        written.append(save_model(model, os.path.join(folder, EXPORT_MEMBERS["model"])))
    for name, chart in (charts or {}).items():
        written.append(save_table(chart, os.path.join(folder, EXPORT_MEMBERS["charts"], f"{name}.parquet")))
    return written


def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(File, Size_KB): top-level members of an export folder with their total
    size in KB rounded to 2, from one listing job."""
    base = folder.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
             .select("path", "length"))
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "")
    member = F.split(rel, "/")[0]
    return (files.groupBy(member.alias("File"))
            .agg(F.round(F.sum("length") / F.lit(1024.0), 2).alias("Size_KB")))

