"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition becomes one *run*: its rows reduced to (SHA-256, byte
length, 64-bit check hash) with the surviving identifier and a row count.  Runs
are merged in rounds: in round r, ``fan_in`` neighbouring runs meet, equal
digests combine, and the surviving identifier is kept (binomial rounds for
``fan_in=2``).  A digest therefore reaches a round at most ``fan_in`` times per
merged run, however many copies it has, and no task ever receives a whole group
of copies.  The way back down the same tree tells every run, and then every row,
the survivor and the size of its group, with the same bound on each join key.

Equality is verified at every level: the merge key is the digest *and* the byte
length *and* an independent 64-bit hash, so two texts count as equal only when
all three agree.

Only DataFrame functions are used; no text is shuffled.

Defined results: a null text counts as empty; null identifiers never survive
next to a real one (a group of null identifiers keeps null); rows that repeat
the surviving identifier and its text are the same document and are all marked
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize

#: how many neighbouring runs one round merges
FAN_IN = 16

_KEY = ["_digest", "_bytes", "_check"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier, verified digest key and run number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_check"),
        F.spark_partition_id().alias("_run"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """Groups of identical texts: id, keep_id, group_size, kept, text_sha256 per row.

    ``keep`` names the survivor of a group: the smallest or the largest identifier.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    survivor = F.min if keep == "smallest" else F.max
    rows = materialize(digest_runs(docs, id_col, text_col), "digest-runs")
    runs = rows.agg(F.max("_run")).first()[0]

    def merged(df: DataFrame, ident: str, size) -> DataFrame:
        return df.groupBy("_run", *_KEY).agg(survivor(ident).alias("_keep"), F.sum(size).alias("_size"))

    levels = [merged(rows, "_id", F.lit(1))]
    while runs:  # until one run is left
        runs //= fan_in
        up = levels[-1].withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        levels.append(materialize(merged(up, "_keep", F.col("_size")), "merged-runs"))
    answer = levels.pop()
    for level in reversed(levels):  # each run learns the answer of the run it merged into
        told = answer.withColumnRenamed("_run", "_parent")
        answer = (level.select("_run", *_KEY, F.floor(F.col("_run") / fan_in).cast("int").alias("_parent"))
                  .join(told, ["_parent", *_KEY]).drop("_parent"))
    return rows.join(answer, ["_run", *_KEY]).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with one row of each group of identical texts, all columns kept."""
    stay = (exact_dedup(docs, id_col, text_col, keep, fan_in).where("kept")
            .select(F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"),
                       F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"))
    return (rows.join(stay, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")),
                      "left_semi")
            .dropDuplicates(["_id", "_sha"]).select("_row.*"))
