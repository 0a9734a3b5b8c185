"""Benchmark decontamination: a prefix-filtered join of shingle sets.

A benchmark item is cut into windows of ``window`` consecutive words (an item of
fewer words is one window).  A document word is *hit* when it lies inside an
occurrence of a window.

1. Every window is a set of word shingles with positions.  A document position
   becomes a candidate token only when its shingle is in the benchmark's shingle
   dictionary: the positions are joined with the dictionary by a 64-bit hash and
   the words themselves are compared in the same join.
2. The shingles are ordered by rarity (their count over all documents).  For
   exact containment every shingle of a window is needed, so its necessary prefix
   is one shingle: the rarest.  Only that one is joined with the occurrences.
3. Positional and length bounds: the window must begin at or after the first word
   of the document and end at or before its last.
4. Verification: shingles that together cover the whole window must occur at
   their offsets.  Shingles are words compared for equality, so a candidate that
   passes is an exact occurrence over an item-sized window.
5. Overlapping occurrences are merged per document with a window over its own
   rows only.

Benchmark tables are broadcast only while they have at most ``broadcast_rows``
rows (counted first; a row is under 1 KB); beyond that the same joins run as
shuffle joins, which AQE splits where a shingle is hot.  Documents are never
shuffled whole: only (document, position) pairs of dictionary shingles move.

Only DataFrame functions are used.

Defined results: null text or text without words has no words, so no hits; null
items have no windows; several rows with the same id are judged by their own
texts; identical rows give identical rows; an empty benchmark hits nothing;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import ascii_lower, materialize

#: everything that is not a digit, a-z or beyond ASCII separates words
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: words of a window
WINDOW = 10
#: words of a shingle (shorter for windows of fewer words)
SHINGLE = 5
#: a broadcast dictionary has at most this many rows
BROADCAST_ROWS = 200_000

_DOC = ["_id", "_text_hash"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: _item, _window (array of words), _len."""
    words = benchmark.select(F.col(id_col).alias("_item"), words_of(F.col(text_col)).alias("_w"))
    size = F.size("_w")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - window + 1))
    return (words.where(size > 0).withColumn("_at", F.explode(starts))
            .select("_item", F.slice("_w", F.col("_at"), window).alias("_window")).distinct()
            .withColumn("_len", F.size("_window")))


def _small(df: DataFrame, most: int) -> DataFrame:
    """Mark ``df`` for broadcast if it was counted to be small; else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _hash_at(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(k)])


def occurrences(docs: DataFrame, shingles: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """(document, position, shingle) for every document position that holds a dictionary shingle."""
    words = docs.select(F.col(id_col).alias("_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"),
                        words_of(F.col(text_col)).alias("_words"))
    found = []
    for k in sizes:
        at = (words.where(F.size("_words") >= k)
              .select(*_DOC, "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - k)).alias("_pos"))
              .withColumn("_hash", _hash_at("_words", F.col("_pos"), k)))
        of_size = shingles.where(F.size("_shingle") == k)
        found.append(at.join(of_size, (at["_hash"] == of_size["_sh_hash"])
                             & (F.slice(at["_words"], at["_pos"] + 1, k) == of_size["_shingle"]))
                     .select(*_DOC, "_pos", "_sh"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                         shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every occurrence of a window: _id, _text_hash, _start, _len, _item."""
    spark = docs.sparkSession
    windows = materialize(item_windows(benchmark, item_id_col, item_text_col, window), "item-windows")
    distinct = windows.select("_window", "_len").distinct().withColumn(
        "_win", F.sha2(F.array_join("_window", " "), 256))
    k = F.least(F.lit(shingle), F.col("_len"))
    parts = distinct.withColumn("_k", k).select(
        "_win", "_len", "_k", F.explode(F.sequence(F.lit(0), F.col("_len") - F.col("_k"))).alias("_off"), "_window")
    parts = parts.select("_win", "_len", "_k", "_off",
                         F.expr("slice(_window, _off + 1, _k)").alias("_shingle"))
    parts = materialize(parts.withColumn("_sh", F.sha2(F.array_join("_shingle", " "), 256)), "window-shingles")
    sizes = sorted(r[0] for r in parts.select("_k").distinct().collect())  # at most ``shingle`` values
    if not sizes:
        return spark.createDataFrame([], "_id long, _text_hash long, _start int, _len int, _item long")
    dictionary = parts.select("_sh", "_shingle", F.lit(0).alias("_x")).dropDuplicates(["_sh"])
    by_size = [dictionary.where(F.size("_shingle") == n).withColumn("_sh_hash", _hash_at("_shingle", F.lit(0), n))
               for n in sizes]
    shingles = by_size[0]
    for more in by_size[1:]:
        shingles = shingles.unionByName(more)
    shingles = materialize(shingles.select("_sh", "_shingle", "_sh_hash"), "shingles")
    occ = materialize(occurrences(docs, _small(shingles, broadcast_rows), sizes, id_col, text_col), "occurrences")

    count = occ.groupBy("_sh").agg(F.count(F.lit(1)).alias("_count"))
    ranked = parts.join(count, "_sh", "left").fillna(0, ["_count"])
    rarest = ranked.groupBy("_win").agg(
        F.min(F.struct("_count", "_sh", "_off")).alias("_first"), F.max("_len").alias("_len"))
    prefix = materialize(rarest.where("_first._count > 0").select(
        "_win", "_len", F.col("_first._sh").alias("_sh"), F.col("_first._off").alias("_off")), "prefixes")

    candidates = (occ.join(_small(prefix, broadcast_rows), "_sh")
                  .withColumn("_start", F.col("_pos") - F.col("_off")).where("_start >= 0")
                  .select(*_DOC, "_start", "_win", "_len").distinct())
    # offsets 0, k, 2k, ... and the last one cover every word of the window
    cover = parts.where((F.col("_off") % F.col("_k") == 0) | (F.col("_off") == F.col("_len") - F.col("_k")))
    needed = cover.groupBy("_win").agg(F.count(F.lit(1)).alias("_needed"))
    cover = cover.join(needed, "_win").select("_win", "_off", "_sh", "_needed")
    wanted = (candidates.join(_small(cover, broadcast_rows), "_win")
              .withColumn("_pos", F.col("_start") + F.col("_off")))
    there = occ.select(F.col("_id").alias("_oid"), F.col("_text_hash").alias("_oth"),
                       F.col("_pos").alias("_opos"), F.col("_sh").alias("_osh")).distinct()
    verified = (wanted.join(there, F.col("_id").eqNullSafe(F.col("_oid")) & (F.col("_text_hash") == F.col("_oth"))
                            & (F.col("_pos") == F.col("_opos")) & (F.col("_sh") == F.col("_osh")))
                .groupBy(*_DOC, "_start", "_win", "_len", "_needed").agg(F.count(F.lit(1)).alias("_n"))
                .where("_n = _needed").select(*_DOC, "_start", "_len", "_win"))
    of_items = windows.select("_item", F.sha2(F.array_join("_window", " "), 256).alias("_win"))
    return verified.join(_small(of_items, broadcast_rows), "_win").select(*_DOC, "_start", "_len", "_item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted item ids as strings), contaminated."""
    hits = materialize(contaminated_windows(docs, benchmark, id_col, text_col, item_id_col, item_text_col,
                                            window, shingle, broadcast_rows), "hits")
    end = F.col("_start") + F.col("_len")
    before = Window.partitionBy(*_DOC).orderBy("_start", end).rowsBetween(Window.unboundedPreceding, -1)
    covered = (hits.select(*_DOC, "_start", "_len").distinct()
               .withColumn("_reached", F.coalesce(F.max(end).over(before), F.lit(0)))
               .groupBy(*_DOC).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("_start", "_reached")))
                                   .alias("n_hit")))
    items = (hits.select(*_DOC, F.col("_item").cast("string").alias("_item")).distinct()
             .groupBy(*_DOC).agg(F.array_sort(F.collect_set("_item")).alias("items")))
    found = covered.withColumnsRenamed({c: c + "_c" for c in _DOC}).join(
        items, F.col("_id_c").eqNullSafe(F.col("_id")) & (F.col("_text_hash_c") == F.col("_text_hash"))).select(
        F.col("_id_c").alias("_fid"), F.col("_text_hash_c").alias("_fth"), "n_hit", "items")
    rows = docs.select(F.col(id_col).alias("_id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"),
                       F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    return (rows.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text_hash") == F.col("_fth")), "left")
            .select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                      shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows whose text holds a window, all columns kept."""
    hits = contaminated_windows(docs, benchmark, id_col, text_col, item_id_col, item_text_col, window, shingle,
                                broadcast_rows)
    bad = materialize(hits.select(*(F.col(c).alias(c + "_h") for c in _DOC)).distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_id_h")) & (F.col("_text_hash") == F.col("_text_hash_h")),
                     "left_anti").select("_row.*")
