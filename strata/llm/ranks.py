"""Positions of rows in a global order, found by range partitions and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import materialize


def positions(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the place (from 0) of a row in its group by ``order``, and ``size`` of the group.

    ``df`` should be a written table: it is read twice.  Rows are range-partitioned by
    group, order and a row number, so a group or a key that many rows share is spread;
    places inside a partition come from its sorted order, and the places before it from
    one count per partition and group.  Nulls come first, strings go by their bytes.
    """
    keys = [*groups, *order, "_tie"]
    placed = materialize(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
        "placed")
    parts = placed.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(*[F.col(c).alias(f"_of{c}") for c in ("_part", *groups)],
                           (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(group).alias("size"))
    here = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in ("_part", *groups)])
    return placed.join(offsets, here).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "size")
