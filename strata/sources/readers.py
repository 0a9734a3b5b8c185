"""Readers: CSV with encoding fallback and pandas-style NA tokens and type
inference, parquet / JSON / ORC by suffix, file information (SURVEY §2.1).

Encoding detection reads the files as text and checks UTF-8 validity per file
in one aggregate (splittable, no UDF).  Type inference is one aggregate over
the string columns; the casts are a lazy projection.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import col
from strata.sources.csv_blocks import read_blocks

# Suffix → reader format.  ".xlsx" is recognised but has no
# splittable Spark reader.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}
UNSUPPORTED = {".xlsx": "Excel workbooks are a single-file, non-splittable codec"}

# Strings read as missing, as pandas' CSV reader does by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Literal booleans recognised in CSV cells.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

ENCODINGS = ("utf-8", "iso-8859-1")
# Cells may hold quoted newlines, so Spark's reader gives a file to one task; larger files
# than ``BLOCK_BYTES`` are read in blocks (``csv_blocks``).
BLOCK_BYTES = 64 << 20
CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true", "emptyValue": "", "nullValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# What a number looks like in a cell; type suffixes such as "1D" are text.
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf(inity)?|INF)$"


def extension(path: str) -> str:
    return os.path.splitext(str(path).rstrip("/"))[1].lower()


def validate_extension(path: str) -> str:
    """The reader format for the path's suffix; ValueError otherwise."""
    ext = extension(path)
    if ext in FORMATS:
        return FORMATS[ext]
    if ext in UNSUPPORTED:
        raise ValueError(f"Unsupported file type '{ext}': {UNSUPPORTED[ext]}.")
    raise ValueError(f"Unsupported file type '{ext}'. Supported: {', '.join(sorted(FORMATS))}.")


def _decoder(encodings) -> str:
    """The one encoding to read with, or "" when a file's own bytes decide."""
    enc = [e.lower().replace("_", "-") for e in encodings]
    return "" if enc[0] in ("utf-8", "utf8", "utf-8-sig") else enc[0].upper()


def file_encodings(spark: SparkSession, path: str, encodings=ENCODINGS) -> dict[str, list[str]]:
    """Files under ``path`` by the first encoding of ``encodings`` that they are valid in.

    One aggregate over the raw lines checks the UTF-8 validity of every file; the
    result has one entry per file.  ISO-8859-1 decodes any bytes, so it ends the chain.
    """
    fixed = _decoder(encodings)
    if fixed:
        return {fixed: [path]}
    valid = (spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")))
    bad = [r["file"] for r in valid.where("NOT ok").collect()]
    if not bad:
        return {"UTF-8": [path]}
    if len(encodings) == 1:
        raise ValueError("File is not valid UTF-8 and no fallback encoding was allowed.")
    good = [r["file"] for r in valid.where("ok").collect()]
    return {k: v for k, v in (("UTF-8", good), (encodings[1].upper(), bad)) if v}


def detect_encoding(spark: SparkSession, path: str, encodings=ENCODINGS) -> str:
    """The encoding of all files under ``path``; the fallback if any file needs it."""
    return list(file_encodings(spark, path, encodings))[-1]


def _null_na(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    return df.select(*[F.when(col(c).isin(*tokens), F.lit(None).cast("string")).otherwise(col(c)).alias(c)
                       for c in df.columns])


def _is_long(v):
    return v.rlike(INT_PATTERN) & v.try_cast("long").isNotNull()


def _is_double(v):
    return v.rlike(FLOAT_PATTERN) & v.try_cast("double").isNotNull()


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns the way pandas' CSV reader would: integers (double
    when the column has a missing value), floats, literal booleans, else string.
    One aggregate decides every column."""
    if not df.columns:
        return df
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(df.columns):
        v = F.trim(col(c))
        present = col(c).isNotNull()
        aggs += [F.count_if(present).alias(f"p{i}"),
                 F.count_if(present & ~_is_long(v)).alias(f"nl{i}"),
                 F.count_if(present & ~_is_double(v)).alias(f"nd{i}"),
                 F.count_if(present & ~col(c).isin(*(TRUE_TOKENS + FALSE_TOKENS))).alias(f"nb{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        n, p = row["__n"], row[f"p{i}"]
        v = F.trim(col(c))
        if p == 0:
            out.append(col(c).cast("double").alias(c) if n > 0 else col(c))
        elif row[f"nl{i}"] == 0:
            out.append(v.try_cast("long").cast("double" if p < n else "long").alias(c))
        elif row[f"nd{i}"] == 0:
            out.append(v.try_cast("double").alias(c))
        elif row[f"nb{i}"] == 0:
            out.append(col(c).isin(*TRUE_TOKENS).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def _scan_files(spark: SparkSession, path: str, encodings) -> DataFrame:
    """The string columns of CSV files, a file per task."""
    reader = spark.read.options(**CSV_OPTIONS).option("inferSchema", "false")
    parts = [reader.option("encoding", enc).csv(files) for enc, files in file_encodings(spark, path, encodings).items()]
    raw = parts[0]
    for more in parts[1:]:
        raw = raw.unionByName(more, allowMissingColumns=True)
    return raw


def scan_csv(spark: SparkSession, path: str, encodings=ENCODINGS, infer: bool = True,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Header CSV: encoding per file, pandas NA tokens nulled, types inferred, cells as
    written (blanks and quoted newlines kept).

    If a file is larger than ``block_bytes``, the files are read in blocks of that size by
    many tasks and their rows kept as parquet in the shared folder.  A table without
    columns or rows raises ValueError.
    """
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    if largest > block_bytes and not _decoder(encodings):
        raw = read_blocks(spark, path, CSV_OPTIONS, block_bytes, encodings[1].upper() if len(encodings) > 1 else None)
    else:
        raw = _scan_files(spark, path, encodings)
    if not raw.columns or raw.isEmpty():
        raise ValueError("Uploaded file contains no data.")
    df = _null_na(raw)
    return infer_types(df) if infer else df


def scan_prediction(spark: SparkSession, path: str) -> DataFrame:
    """Scoring input: CSV, UTF-8 only."""
    validate_extension(path)
    return scan_csv(spark, path, encodings=("utf-8",))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the suffix; CSV goes through ``scan_csv``."""
    fmt = validate_extension(path)
    if fmt == "csv":
        return scan_csv(spark, path)
    return spark.read.format(fmt).load(path)


def basic_cleaning(df: DataFrame) -> DataFrame:
    """trim + dedupe names → parse datetime strings (columns where every value
    parses) → tighten types."""
    from strata.operators.schema import trim_dedupe_columns
    from strata.operators.types import parse_datetime, tighten_types
    return tighten_types(parse_datetime(trim_dedupe_columns(df)))


def file_info(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """One row: name, extension, bytes (sum over the files), rows, columns, memory_mb."""
    from strata.operators.profile import memory_bytes_expr
    files = spark.read.format("binaryFile").load(path).select("length")
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("v")) \
        .select(F.lit("bytes").alias("k"), "v")
    stats = df.agg(F.count(F.lit(1)).cast("long").alias("rows"), memory_bytes_expr(df).alias("mem"))
    parts = size.unionByName(stats.select(F.lit("rows").alias("k"), F.col("rows").alias("v"))) \
        .unionByName(stats.select(F.lit("mem").alias("k"), F.col("mem").alias("v")))
    piv = parts.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("bytes", "rows", "mem")])
    return piv.select(F.lit(os.path.basename(str(path).rstrip("/"))).alias("name"),
                      F.lit(extension(path)).alias("extension"), "bytes", "rows",
                      F.lit(len(df.columns)).cast("long").alias("columns"),
                      F.round(F.col("mem") / F.lit(1024.0 ** 2), 2).alias("memory_mb"))


def load_and_prepare(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """scan → validate (ValueError with the issues joined) → basic cleaning →
    (table, file information)."""
    from strata.operators.schema import validate_dataset
    df = load_table(spark, path)
    issues = [r["issue"] for r in validate_dataset(df).orderBy("seq").collect()]
    if issues:
        raise ValueError(" ".join(issues))
    clean = basic_cleaning(df)
    return clean, file_info(spark, path, clean)
