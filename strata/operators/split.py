"""Train/test splits and cross-validation folds.

Default splits are hash cuts: ``md5(id ':' seed)`` compared with a hex bound —
no shuffle, reproducible, identical in any SQL engine with md5.  The exact
stratified variant finds, per class, the hash of the row at each wanted rank, from
counts of hash prefixes; rows are then flagged by comparing hashes in a projection.
Only (class, hash) pairs are counted, feature columns never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import col

TEST_SIZE = 0.20
SEED = 42
FOLDS = 5


def hash_key(id_cols, seed: int = SEED) -> Column:
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return F.md5(F.concat_ws(":", *[col(c).cast("string") for c in ids], F.lit(str(seed))))


def hex_bound(share: float) -> str:
    """8-hex-digit bound b with P(md5 prefix < b) = share."""
    return format(min(int(round(share * 2 ** 32)), 2 ** 32 - 1), "08x")


def hash_split(df: DataFrame, id_cols, test_size: float = TEST_SIZE, seed: int = SEED,
               flag: str = "is_test") -> DataFrame:
    """Adds boolean ``flag``: md5(id:seed) < bound(test_size)."""
    return df.withColumn(flag, hash_key(id_cols, seed) < F.lit(hex_bound(test_size)))


def hash_fold(id_cols, k: int = FOLDS, seed: int = SEED) -> Column:
    """Fold number 0..k-1 from the first 8 hex digits cut at k−1 equal bounds."""
    prefix = F.conv(F.substring(hash_key(id_cols, seed), 1, 8), 16, 10).cast("long")
    return F.floor(prefix * F.lit(k) / F.lit(float(2 ** 32))).cast("int")


#: hex digits of the hash prefixes that are counted: at most 65,536 per class
PREFIX_DIGITS = 4


def rank_cutoffs(df: DataFrame, label: str, key: Column, ranks: list[Column]) -> DataFrame:
    """(__lab, __cuts): per class, the hash of the row at each of ``ranks`` (1-based, in hash
    order; expressions of the class size ``__n``), "" for rank 0.

    The first aggregate counts hash prefixes per class; running sums over a class's
    prefixes (65,536 at most) name the prefix that holds each rank, and only the rows
    with such a prefix are ordered by their whole hash.
    """
    keyed = df.select(col(label).alias("__lab"), key.alias("__h"))
    prefix = F.substring("__h", 1, PREFIX_DIGITS)
    counts = keyed.groupBy("__lab", prefix.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy("__lab").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumn("__upto", F.sum("__c").over(upto)).withColumn(
        "__n", F.sum("__c").over(Window.partitionBy("__lab")))
    wanted = sums.select("__lab", "__p", "__c", "__upto", F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias(
        "__j", "__rank"))
    inside = (F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__c"))
    holds = wanted.where(inside).select("__lab", "__p", "__j", (F.col("__rank") - F.col("__upto") + F.col("__c")).alias("__r"))
    near = keyed.withColumn("__p", prefix)
    lists = holds.groupBy("__lab", "__p").agg(F.collect_list(F.struct("__j", "__r")).alias("__want"))
    rows = near.join(lists, near["__lab"].eqNullSafe(lists["__lab"]) & (near["__p"] == lists["__p"])).select(
        near["__lab"], near["__p"], "__h", "__want")
    order = Window.partitionBy("__lab", "__p").orderBy("__h")
    found = (rows.withColumn("__at", F.row_number().over(order))
             .select("__lab", "__h", "__at", F.explode("__want").alias("__w")).where("__at = __w.__r"))
    per_class = found.groupBy("__lab").agg(F.collect_list(F.struct(F.col("__w.__j").alias("j"), F.col("__h").alias("h")))
                                           .alias("__found"))
    classes = counts.groupBy("__lab").agg(F.sum("__c").alias("__n"))
    joined = classes.join(per_class.withColumnRenamed("__lab", "__l2"), F.col("__lab").eqNullSafe(F.col("__l2")), "left")
    cuts = F.array(*[F.coalesce(F.element_at(F.map_from_entries("__found"), j), F.lit("")) for j in range(len(ranks))])
    return joined.select("__lab", cuts.alias("__cuts"))


def stratified_split(df: DataFrame, label: str, id_cols, test_size: float = TEST_SIZE,
                     seed: int = SEED, flag: str = "is_test", k_folds: int | None = None,
                     fold_col: str = "fold") -> DataFrame:
    """Exact stratified split: in each class the round(test_size·n_class) rows
    with the smallest md5(id:seed) are test rows.  With ``k_folds`` also adds
    ``fold``: the class's rows in hash order cut into k parts of equal size
    (part f ends at rank round(n·(f+1)/k))."""
    key = hash_key(id_cols, seed)
    n = F.col("__n")
    ranks = [F.round(n * F.lit(test_size))] + [F.round(n * F.lit((f + 1) / k_folds)) for f in range((k_folds or 1) - 1)]
    cuts = rank_cutoffs(df, label, key, ranks)  # one row per class
    j = df.join(cuts, col(label).eqNullSafe(F.col("__lab")), "left")
    out = j.withColumn(flag, key <= F.col("__cuts")[0])
    if k_folds:
        fold = sum(((key > F.col("__cuts")[f + 1]).cast("int") for f in range(k_folds - 1)), F.lit(0))
        out = out.withColumn(fold_col, fold.cast("int"))
    return out.drop("__lab", "__cuts")
