"""Helpers shared by the operators: text columns, shared tables, run numbering."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs a file read and not a recomputation,
    and fixes the values of per-partition columns such as ``spark_partition_id``.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that for pure ASCII text and is
    much faster than ``translate``, so it serves the rows without other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose strings or lists in ``column`` add up to about ``size`` bytes or elements.

    A batch of 10,000 long texts is tens of MB; worked on slice by slice, a Python
    worker needs little more than the batch itself.
    """
    lists = pa.types.is_list(batch.column(column).type)
    length = pc.fill_null(pc.list_value_length(batch.column(column)) if lists
                          else pc.binary_length(batch.column(column)), 0)
    group = np.cumsum(np.asarray(length, np.int64)) // size
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


#: rows of an Arrow batch between Spark and Python workers; documents average some KB
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` if it is larger: with long texts the
    default of 10,000 rows is tens of MB, held by the executor and by every Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system, at the end of a task or a fit: Python workers
    live on between tasks, and what their allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(fn):
    """``fn`` of a group (or of a cogroup's two), whose worker returns freed memory after it."""
    def one(table):
        out = fn(table)
        give_back()
        return out

    def two(left, right):
        out = fn(left, right)
        give_back()
        return out

    return functools.wraps(fn)(one if fn.__code__.co_argcount == 1 else two)
