"""Merkle dataset manifest by cogrouped subtree exchange.

Every row is a leaf: the SHA-256 of its fields, each written as its length and value.
The leaves of a group (a language, say), in the order of their ids, are folded into a
subroot, ``arity`` consecutive nodes at a time, and the subroots, in the order of the
groups, into the root of the dataset.  A row's proof are the siblings on its way to the
root; folding an observed leaf with them gives the root again only if nothing changed.

No task sees a whole tree.  Leaves get their places from range partitions
(``ranks.positions``), and ``arity ** LEVELS`` consecutive ones form a superblock:

* Up: each superblock is reduced to one node; the nodes of all superblocks form the
  next table, until one node per group is left.  The tables shrink by the size of a
  superblock each time.
* Down: the nodes that a superblock needs from outside are the siblings on the path
  from its own node to the root, a few strings.  From the top table on, each table is
  *cogrouped* by superblock with these outer paths in ``applyInPandas``, which reduces
  the block again, puts local siblings before the outer ones, and (for leaves) folds.

A group of the cogroup holds at most ``arity ** LEVELS`` rows (4,096) and one path, so
neither a large group nor many small ones crowd a task, and texts never move: leaves
are hashed in the scan.

Defined results: a null field counts as ``-``; ids are ordered as numbers or strings,
nulls first; among rows with one id and group, the leaf decides, so rows that repeat
fully take neighbouring places and have equal leaves; a group of one row has its leaf
as subroot, one group's subroot is the root; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import materialize
from strata.llm.ranks import positions

#: consecutive nodes that are folded into one, and levels of a superblock
ARITY, LEVELS = 2, 12


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, otherwise length in UTF-8 bytes, ``:``, value."""
    def written(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[written(c) for c in fields]), 256)


def reduced(nodes: list[str], arity: int, levels: int | None) -> list[list[str]]:
    """All levels above (and with) ``nodes``: ``levels`` of them, or (None) until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        row = out[-1]
        out.append([digest("".join(row[i:i + arity])) for i in range(0, len(row), arity)])
    return out


def siblings(rows: list[list[str]], i: int, arity: int) -> list[str]:
    """Per level below the last one: digests left of node ``i``'s path, ``|``, and right of it."""
    path = []
    for row in rows[:-1]:
        a = i - i % arity
        path.append("".join(row[a:i]) + "|" + "".join(row[i + 1:a + arity]))
        i //= arity
    return path


def fold(leaf: str, path: str) -> str:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    for level in path.split(";") if path else []:
        left, right = level.split("|")
        leaf = digest(left + leaf + right)
    return leaf


def _height(size: int, arity: int, levels: int) -> int | None:
    """Levels of a superblock: all of them unless it is the only one of its group."""
    return levels if size > arity ** levels else None


def _up(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One node per superblock of ``nodes`` (grp, pos, size, node)."""
    block = arity ** levels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.sort_values("pos")
        size = int(row["size"].iloc[0])
        top = reduced(row["node"].tolist(), arity, _height(size, arity, levels))[-1][0]
        return pd.DataFrame({"grp": [row["grp"].iloc[0]], "pos": [int(row["_block"].iloc[0])],
                             "size": [-(-size // block)], "node": [top]})

    blocks = nodes.select("grp", "pos", "size", "node", (F.col("pos") / block).cast("long").alias("_block"))
    return blocks.groupBy("grp", "_block").applyInPandas(run, "grp binary, pos long, size long, node string")


def _down(nodes: DataFrame, outer: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` with ``path``, their siblings up to the root, from the paths of their superblocks.

    Rows of leaves (those with ``id`` and ``seen``) also get the root that the seen leaf folds to.
    """
    block = arity ** levels
    extra = [c for c in ("id", "seen") if c in nodes.columns]

    def run(pdf: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        row = pdf.sort_values("pos")
        size = int(row["size"].iloc[0])
        rows = reduced(row["node"].tolist(), arity, _height(size, arity, levels))
        above = paths.iloc[0]
        end = [above["path"]] if above["path"] else []
        out = row[["grp", "pos", *extra, "node"]].copy()
        out["path"] = [";".join(siblings(rows, i, arity) + end) for i in range(len(row))]
        out["subroot"], out["root"] = above["subroot"], above["root"]
        if extra:
            out["folded"] = [fold(node if seen is None else seen, path)
                             for node, seen, path in zip(out["node"], out["seen"], out["path"])]
        return out

    blocks = nodes.withColumn("_block", (F.col("pos") / block).cast("long"))
    keyed = outer.select("grp", F.col("pos").alias("_block"), "path", "subroot", "root")
    schema = ("grp binary, pos long, " + ("id string, seen string, " if extra else "")
              + "node string, path string, subroot string, root string" + (", folded string" if extra else ""))
    return (blocks.groupBy("grp", "_block").cogroup(keyed.groupBy("grp", "_block"))
            .applyInPandas(run, schema))


def _tower(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the tables above, down to one node per group; all are written tables."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        out.append(materialize(_up(out[-1], arity, levels), "merkle-up"))
    return out


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    id_col: str = "doc_id", group_col: str = "lang", observed: dict[str, Column] | None = None,
                    arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof, folded_root, verified per row.

    ``proof`` lists the siblings level by level up to the root: digests left of the path,
    ``|``, digests right of it, levels separated by ``;``.  ``observed`` replaces fields of
    the rows that are checked against the manifest (as if read again later); ``folded_root``
    is what their leaves and the proofs give, and ``verified`` whether that is the root.
    """
    if arity < 2 or levels < 1:
        raise ValueError("arity must be at least 2 and levels at least 1")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    now = [F.col(c) for c in fields]
    seen = leaf_digest([(observed or {}).get(c, F.col(c)) for c in fields]) if observed else F.lit(None).cast("string")
    changed = F.lit(False)
    for name, value in (observed or {}).items():
        changed = changed | ~value.cast("string").eqNullSafe(F.col(name).cast("string"))
    leaves = docs.select(F.encode(F.col(group_col).cast("string"), "UTF-8").alias("grp"), F.col(id_col).alias("id"),
                         leaf_digest(now).alias("node"), F.when(changed, seen).alias("seen"))
    placed = positions(materialize(leaves, "merkle-leaves"), ["grp"], ["id", "node"])
    tower = _tower(materialize(placed.withColumn("id", F.col("id").cast("string")), "merkle-placed"), arity, levels)

    # the subroots are the leaves of one more tree, whose group is a constant
    subroots = tower[-1].select("grp", "node")
    ranked = positions(subroots, [], ["grp"]).select(F.col("grp").alias("_of"), F.lit(b"").alias("grp"), "pos", "size",
                                                     "node")
    ranked = materialize(ranked, "merkle-subroots")
    over = _tower(ranked.drop("_of"), arity, levels)
    paths = over[-1].select("grp", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(over):
        paths = _down(nodes, paths, arity, levels)
    paths = materialize(paths, "merkle-paths")
    down = ranked.select("_of", "pos", F.col("node").alias("subroot")).join(paths.select("pos", "path", "root"), "pos").select(
        F.col("_of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    for nodes in reversed(tower):
        down = _down(nodes, down, arity, levels)
    return down.select(F.col("id").cast(kind).alias(id_col), F.col("node").alias("leaf"), "subroot", "root",
                       F.col("path").alias("proof"), F.col("folded").alias("folded_root"),
                       (F.col("folded") == F.col("root")).alias("verified"))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests, level by level, left to right."""
    return F.sha2(F.translate(proof, "|;", ""), 256)
