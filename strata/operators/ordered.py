"""Global order statistics without a single-partition window.

``running_sums`` gives every row its position in a total order and inclusive
running sums of some columns.  The rows are range-partitioned on the order
key, materialised once with a reliable checkpoint (so both passes see the same
partitions), per-partition totals — one row per partition — become offsets,
and a window *within* each partition finishes the sums.  Nothing grows with
the data on the driver or in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir


def running_sums(df: DataFrame, order_cols: list[str], sum_cols: list[str],
                 partitions: int | None = None, rank_col: str = "_rank",
                 checkpoint: bool = True) -> DataFrame:
    """df + ``rank_col`` (1-based position in ``order_cols`` order) + ``cum_<c>``
    (inclusive running sum) for each of ``sum_cols``.  Ties in the order keys
    are broken arbitrarily, so callers order by keys that are unique.

    Without ``partitions`` Spark sizes the ranges itself (adaptive execution)."""
    spark = df.sparkSession
    ranged = (df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols))
    ranged = ranged.sortWithinPartitions(*order_cols)
    if checkpoint:
        ensure_checkpoint_dir(spark)
        ranged = ranged.checkpoint(eager=True)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    totals = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                        *[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sum_cols)]).collect()
    # exclusive offsets per partition, in partition (= range) order; one row per partition
    rows, acc_n, acc = [], 0, {c: 0 for c in sum_cols}
    for r in sorted(totals, key=lambda r: r["_pid"]):
        rows.append((r["_pid"], acc_n, *[acc[c] for c in sum_cols]))
        acc_n += r["_n"]
        for i, c in enumerate(sum_cols):
            acc[c] = acc[c] + (r[f"_t{i}"] or 0)
    schema = "_pid int, _offrows long" + "".join(
        f", _off{i} {'double' if isinstance(acc[c], float) else 'long'}" for i, c in enumerate(sum_cols))
    offsets = spark.createDataFrame(rows, schema)
    w = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols))
                          .alias("_local_rank"),
                          *[F.sum(c).over(w).alias(f"_local{i}") for i, c in enumerate(sum_cols)])
    out = local.join(F.broadcast(offsets), "_pid")
    return out.select(*[F.col(c) for c in df.columns],
                      (F.col("_local_rank") + F.col("_offrows")).alias(rank_col),
                      *[(F.col(f"_local{i}") + F.col(f"_off{i}")).alias(f"cum_{c}") for i, c in enumerate(sum_cols)])


def neighbours(df: DataFrame, rank_col: str, cols: list[str]) -> DataFrame:
    """Attach the previous and next row's ``cols`` (by rank) with two equi-joins
    on the rank — a shuffle, no global window."""
    prev = df.select((F.col(rank_col) + 1).alias(rank_col), *[F.col(c).alias(f"prev_{c}") for c in cols])
    nxt = df.select((F.col(rank_col) - 1).alias(rank_col), *[F.col(c).alias(f"next_{c}") for c in cols])
    return df.join(prev, rank_col, "left").join(nxt, rank_col, "left")
