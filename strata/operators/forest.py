"""Classifying forests over many rows, grown where the rows of a node meet.

A pass of Spark ML over the data serves some nodes of a level, and the driver books them all; the
trees of a forest whose leaves hold a few rows have about as many nodes as rows, each.  Here rows
are binned once and kept in blocks on shared storage.  Every row is drawn a Poisson number of times
for every tree.  Nodes of more than ``WHOLE`` drawn rows are split by sums over all blocks, a job
for a level of all trees; the rows of a smaller node then meet in one task, which grows all that is
below.  So jobs are as many as the levels above ``WHOLE`` rows, a task holds one node of that size,
and what the driver holds are the nodes above it.

The rules are those of Spark ML's forests: thresholds from a sample, a draw of features for every
node, the gini gain, no split without gain, leaves of one predicted class under one node joined
(not across the border of a small node), a tree's vote the shares of the classes in its leaf.
The grown trees stay on shared storage; scoring reads them tree by tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.grid import BINS, SAMPLE, thresholds
from strata.session import scratch_path

#: rows from which on forests are grown here, and the most classes
FROM_ROWS, MOST_CLASSES = 5_000, 100
#: drawn rows of a node that one task finishes
WHOLE = 32_768
#: rows of a block, and rows that a task of a level takes
BLOCK, TASK_ROWS = 2_048, 65_536
#: sums that a task holds in one pass
SUMS = 1 << 23
#: rows scored together
SCORED = 32_768

_PIECE = "tree int, node int, feature binary, upto binary, left binary, mixed binary, gained binary"


def binned(x: np.ndarray, ends: list[list[float]]) -> np.ndarray:
    """The number of ``ends`` below every value."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(ends):
        out[:, j] = np.searchsorted(np.asarray(e, float), x[:, j], side="left")
    return out


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    if lists.null_count:
        raise ValueError("features must not be null")
    x = np.asarray(lists.flatten(), float)
    if len(x) != len(lists) * width or not np.isfinite(x).all():
        raise ValueError(f"features must be {width} finite numbers a row")
    return x.reshape(-1, width)


def write_blocks(rows: DataFrame, ends: list[list[float]], path: str) -> None:
    """(block, x, y) of the rows (x array<double>, y int), a byte for every bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            x, y = binned(_matrix(batch.column(0), len(ends)), ends), np.asarray(batch.column(1), np.int32)
            for at in range(0, len(y), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([x[at:at + BLOCK].tobytes()], pa.binary()),
                                                  pa.array([y[at:at + BLOCK].tobytes()], pa.binary())], ["block", "x", "y"])
                block += 1
    rows.mapInArrow(run, "block long, x binary, y binary").write.parquet(path)


def _open(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
        yield b, np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width), np.frombuffer(y.as_buffer(), np.int32)


def drawn(seed: int, block: int, trees: int, rows: int) -> np.ndarray:
    """How often each tree draws each row of a block (trees x rows); the same in every pass."""
    return np.random.default_rng([seed, block]).poisson(1.0, (trees, rows)).astype(np.uint8)


def some_features(rng: np.random.Generator, nodes: int, features: int, some: int) -> np.ndarray:
    """A draw of ``some`` different features for each node (nodes x some)."""
    order = np.tile(np.arange(features, dtype=np.int32), (nodes, 1))
    every = np.arange(nodes)
    for j in range(some):
        other = rng.integers(j, features, nodes)
        mine = order[every, other]
        order[every, other] = order[:, j]
        order[:, j] = mine
    return order[:, :some].copy()


def walk(feature: np.ndarray, upto: np.ndarray, left: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The node that each row of ``x`` comes to from node ``at``."""
    at, going = at.copy(), np.flatnonzero(feature[at] >= 0)
    while len(going):
        here = at[going]
        at[going] = here = left[here] + (x[going, feature[here]] > upto[here])
        going = going[feature[here] >= 0]
    return at


def gain_of(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows times the gini gain of parting ``left`` from ``total`` (last axis: classes); -1 for empty sides."""
    right = total - left
    n_left, n_right, n = left.sum(-1), right.sum(-1), total.sum(-1)
    gain = ((left * left).sum(-1) / np.maximum(n_left, 1) + (right * right).sum(-1) / np.maximum(n_right, 1)
            - (total * total).sum(-1) / np.maximum(n, 1))
    return np.where((n_left > 0) & (n_right > 0), gain, -1.0)


#: a gain below this share of the rows is a rounding error
_LEAST = 1e-12


# -- one node's rows: all that is below it -----------------------------------------------------

@dataclass
class Grown:
    """Nodes of a tree, the root first; the children of node i are left[i] and left[i] + 1.
    A leaf has feature -1 and its class as ``left``, or -2 and the row of ``mixed`` (counts of classes)."""
    feature: np.ndarray
    upto: np.ndarray
    left: np.ndarray
    mixed: np.ndarray
    gained: np.ndarray


def grow(x: np.ndarray, y: np.ndarray, classes: int, some: int, depth: int, rng: np.random.Generator) -> Grown:
    """A tree over drawn rows, level by level, for all its nodes at a time."""
    features, gained = x.shape[1], np.zeros(x.shape[1])
    rows, label, node = np.arange(len(y)), y.astype(np.int64), np.zeros(len(y), np.int64)
    counts = np.bincount(label, minlength=classes).reshape(1, -1)
    feature, upto, left, seen, first = [], [], [], [], 0
    for level in range(depth + 1):
        k = len(counts)
        feature.append(np.full(k, -1, np.int16))
        upto.append(np.zeros(k, np.uint8))
        left.append(counts.argmax(axis=1).astype(np.int32))
        seen.append(counts.astype(np.int32))
        mixed = (counts > 0).sum(axis=1) > 1
        if level == depth or not mixed.any():
            break
        # only nodes of several classes go on, numbered anew
        number, stay = np.cumsum(mixed) - 1, mixed[node]
        rows, label, node = rows[stay], label[stay], number[node[stay]]
        total = counts[mixed].astype(float)
        k = len(total)
        n = total.sum(axis=1)
        squares = (total * total).sum(axis=1) / n
        best, best_f, best_u = _LEAST * n, np.full(k, -1, np.int64), np.zeros(k, np.int64)
        for f in some_features(rng, k, features, some).T:
            # the (node, bin) that have rows, in order
            at = node * BINS + x[rows, f[node]]
            present = np.zeros(k * BINS, bool)
            present[at] = True
            cells = np.flatnonzero(present)
            slot = np.cumsum(present) - 1
            of, start = cells // BINS, slot[np.arange(k) * BINS] + ~present[np.arange(k) * BINS]
            here = np.bincount(slot[at] * classes + label, minlength=len(cells) * classes).reshape(-1, classes).astype(float)
            upto_here = here.cumsum(axis=0)
            below = upto_here - (upto_here[start] - here[start])[of]
            n_left, all_ = below.sum(axis=1), total[of]
            in_left = np.einsum("ij,ij->i", below, below)
            above = all_ - below
            n_right = n[of] - n_left
            gain = in_left / n_left + np.einsum("ij,ij->i", above, above) / np.maximum(n_right, 1) - squares[of]
            gain[n_right == 0] = -1
            top = np.maximum.reduceat(gain, start)
            hit = np.flatnonzero(gain == top[of])[::-1]
            where = np.empty(k, np.int64)
            where[of[hit]] = cells[hit] % BINS  # the first of equal ones is written last
            better = top > best
            best[better], best_f[better], best_u[better] = top[better], f[better], where[better]
        split = best_f >= 0
        if not split.any():
            break
        np.add.at(gained, best_f[split], best[split])
        who = np.flatnonzero(mixed)[split]
        first += len(counts)
        feature[-1][who], upto[-1][who] = best_f[split], best_u[split]
        left[-1][who] = first + 2 * np.arange(len(who))
        rank, stay = np.cumsum(split) - 1, split[node]
        rows, label, node = rows[stay], label[stay], node[stay]
        node = 2 * rank[node] + (x[rows, best_f[node]] > best_u[node])
        counts = np.bincount(node * classes + label, minlength=2 * len(who) * classes).reshape(-1, classes)
    return _pruned(feature, upto, left, seen, gained)


def _pruned(feature: list, upto: list, left: list, seen: list, gained: np.ndarray) -> Grown:
    """The levels as one tree: two leaves of one predicted class become one."""
    starts = np.cumsum([0] + [len(f) for f in feature])
    said = [c.argmax(axis=1) for c in seen]
    for level in range(len(feature) - 2, -1, -1):
        inner = np.flatnonzero(feature[level] >= 0)
        a = left[level][inner] - starts[level + 1]
        alike = ((feature[level + 1][a] < 0) & (feature[level + 1][a + 1] < 0) & (said[level + 1][a] == said[level + 1][a + 1]))
        feature[level][inner[alike]] = -1
    feature, upto, left, seen = np.concatenate(feature), np.concatenate(upto), np.concatenate(left), np.concatenate(seen)
    several = np.flatnonzero((feature < 0) & ((seen > 0).sum(axis=1) > 1))
    feature[several], left[several] = -2, np.arange(len(several))
    one = feature == -1
    left[one] = seen[one].argmax(axis=1)
    return Grown(feature, upto, left, seen[several], gained)


# -- nodes of many rows: sums over all blocks -----------------------------------------------------

class Top:
    """The nodes of all trees with more than ``WHOLE`` drawn rows, and what hangs below them.

    Node t is the root of tree t.  ``feature`` is that of a split; -1: a piece grown in a task; -2: a leaf."""

    def __init__(self, trees: int):
        self.feature, self.upto, self.left = np.full(trees, -1, np.int32), np.zeros(trees, np.int32), np.zeros(trees, np.int32)
        self.tree, self.level = np.arange(trees), np.zeros(trees, np.int64)
        self.leaves: dict[int, list[float]] = {}

    def add(self, tree: np.ndarray, level: int) -> np.ndarray:
        new = np.arange(len(self.tree), len(self.tree) + len(tree))
        self.feature = np.concatenate([self.feature, np.full(len(new), -1, np.int32)])
        self.upto, self.left = (np.concatenate([a, np.zeros(len(new), np.int32)]) for a in (self.upto, self.left))
        self.tree, self.level = np.concatenate([self.tree, tree]), np.concatenate([self.level, np.full(len(new), level)])
        return new

    def leaf(self, node: int, counts) -> None:
        self.feature[node], self.leaves[int(node)] = -2, [float(c) for c in counts]


def _best_splits(blocks: DataFrame, top: Top, nodes: np.ndarray, drawn_features: np.ndarray, width: int, classes: int,
                 trees: int, seed: int) -> list:
    """(node, feature or -1, bin, gain, left counts, right counts) of ``nodes``, which are sorted by tree."""
    some, feature, upto, left = drawn_features.shape[1], top.feature, top.upto, top.left
    at_node = np.full(len(feature), -1, np.int64)
    at_node[nodes] = np.arange(len(nodes))
    of_tree = top.tree[nodes]
    bounds = {int(t): (int(np.searchsorted(of_tree, t)), int(np.searchsorted(of_tree, t, "right"))) for t in np.unique(of_tree)}
    shape = (some, BINS, classes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(nodes), *shape), np.int64)
        for batch in batches:
            for block, x, y in _open(batch, width):
                times = drawn(seed, block, trees, len(y))
                for t, (lo, hi) in bounds.items():
                    rows = np.repeat(np.arange(len(y)), times[t])
                    at = at_node[walk(feature, upto, left, x[rows], np.full(len(rows), t))]
                    rows, at = rows[at >= 0], at[at >= 0]
                    for j in range(some):
                        key = ((at - lo) * BINS + x[rows, drawn_features[at, j]]) * classes + y[rows]
                        out[lo:hi, j] += np.bincount(key, minlength=(hi - lo) * BINS * classes).reshape(hi - lo, BINS, classes)
        for i in range(0, len(nodes), 64):
            part = out[i:i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(part)), pa.int32()), pa.array([p.tobytes() for p in part], pa.binary())],
                                             ["at", "sums"])

    def choose(table: pa.Table) -> pa.Table:
        i = table["at"][0].as_py()
        found = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table["sums"]).reshape(shape).astype(float)
        total = found[0].sum(axis=0)
        below = found.cumsum(axis=1)
        gain = gain_of(below, total)
        j, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[j, b] > _LEAST * total.sum():
            row = int(drawn_features[i, j]), int(b), float(gain[j, b]), below[j, b].tolist(), (total - below[j, b]).tolist()
        else:
            row = -1, 0, 0.0, total.tolist(), [0.0] * classes
        return pa.table({"node": pa.array([int(nodes[i])], pa.int32()), "feature": pa.array([row[0]], pa.int32()),
                         "upto": pa.array([row[1]], pa.int32()), "gain": pa.array([row[2]], pa.float64()),
                         "l": pa.array([row[3]], pa.list_(pa.float64())), "r": pa.array([row[4]], pa.list_(pa.float64()))})

    return blocks.mapInArrow(sums, "at int, sums binary").groupBy("at").applyInArrow(
        choose, "node int, feature int, upto int, gain double, l array<double>, r array<double>").collect()


def grow_top(blocks: DataFrame, rows: int, width: int, classes: int, trees: int, some: int, depth: int, seed: int,
             whole: int) -> tuple[Top, np.ndarray]:
    """The nodes above ``whole`` rows, and what each tree gained there by each feature."""
    top, gained = Top(trees), np.zeros((trees, width))
    open_ = np.arange(trees) if rows > whole else np.zeros(0, np.int64)
    level = 0
    while len(open_):
        picked = some_features(np.random.default_rng([seed, 1, level]), len(open_), width, some)
        most, found = max(1, SUMS // (some * BINS * classes)), []
        for at in range(0, len(open_), most):
            found += _best_splits(blocks, top, open_[at:at + most], picked[at:at + most], width, classes, trees, seed)
        level, ahead = level + 1, []
        for r in found:
            if r["feature"] < 0:
                top.leaf(r["node"], r["l"])
        found = sorted((r for r in found if r["feature"] >= 0), key=lambda r: r["node"])
        new = top.add(np.repeat(top.tree[[r["node"] for r in found]], 2), level).reshape(-1, 2) if found else []
        for r, children in zip(found, new):
            node = r["node"]
            gained[top.tree[node], r["feature"]] += r["gain"]
            top.feature[node], top.upto[node], top.left[node] = r["feature"], r["upto"], children[0]
            for child, counts in zip(children, (r["l"], r["r"])):
                if level == depth or sum(c > 0 for c in counts) < 2:
                    top.leaf(child, counts)
                elif sum(counts) > whole:
                    ahead.append(child)
        open_ = np.array(sorted(ahead, key=lambda i: (top.tree[i], i)), np.int64)
    return top, gained


def write_pieces(blocks: DataFrame, top: Top, rows: int, width: int, classes: int, trees: int, some: int, depth: int, seed: int,
                 tasks: int, path: str) -> None:
    """The rows of every small node meet in a task, which writes all that grows below it."""
    feature, upto, left, level = top.feature, top.upto, top.left, top.level

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x, y in _open(batch, width):
                times = drawn(seed, block, trees, len(y))
                for t in range(trees):
                    took = np.flatnonzero(times[t])
                    at = walk(feature, upto, left, x[took], np.full(len(took), t))
                    took, at = took[feature[at] == -1], at[feature[at] == -1]
                    order = np.argsort(at, kind="stable")
                    took, at = took[order], at[order]
                    found, start = np.unique(at, return_index=True)
                    parts = np.split(took, start[1:])
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int64()),
                             pa.array([x[p].tobytes() for p in parts], pa.binary()), pa.array([y[p].tobytes() for p in parts], pa.binary()),
                             pa.array([times[t][p].tobytes() for p in parts], pa.binary())], ["tree", "node", "block", "x", "y", "times"])

    def piece(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        table = table.sort_by("block")  # the same rows in the same order, whatever order they came in
        x = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for b in table["x"]]).reshape(-1, width)
        y = np.concatenate([np.frombuffer(b.as_buffer(), np.int32) for b in table["y"]])
        times = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for b in table["times"]])
        took = np.repeat(np.arange(len(y)), times)
        g = grow(x[took], y[took], classes, some, depth - int(level[node]), np.random.default_rng([seed, 2, node]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{c: pa.array([getattr(g, c).tobytes()], pa.binary()) for c in ("feature", "upto", "left", "mixed", "gained")}})

    (blocks.mapInArrow(deal, "tree int, node int, block long, x binary, y binary, times binary").repartition(tasks, "tree", "node")
     .groupBy("tree", "node").applyInArrow(piece, _PIECE).write.parquet(path))


# -- the forest -----------------------------------------------------------------------------------

def fit_forest(df: DataFrame, features_col: str, label_col: str, trees: int, depth: int, seed: int,
               from_rows: int | None = None, whole: int | None = None) -> PieceForest | None:
    """A forest of ``trees`` with a draw of sqrt(features) for a node; none if rows are few or classes many."""
    least, whole = FROM_ROWS if from_rows is None else from_rows, WHOLE if whole is None else whole
    spark = df.sparkSession
    rows = df.select(vector_to_array(features_col).alias("x"), F.col(label_col).cast("int").alias("y"))
    first = rows.select(F.size("x")).first()
    if first is None or first[0] < 1:
        return None
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, classes = rows.agg(F.count(F.lit(1)), F.max("y") + 1).first()
        if n < max(least, 1) or not 2 <= classes <= MOST_CLASSES:
            return None
        width, some = first[0], math.ceil(math.sqrt(first[0]))
        sample = (rows.sample(False, SAMPLE / n, seed) if n > SAMPLE else rows).select("x").collect()  # about SAMPLE rows
        x = np.array([r["x"] for r in sample], float).reshape(-1, width)
        ends = [thresholds(x[:, j]) for j in range(width)]
        cores = spark.sparkContext.defaultParallelism
        tasks, path = max(cores, -(-n // TASK_ROWS)), scratch_path(spark, "forest-blocks")
        write_blocks(rows.repartition(tasks), ends, path)
    finally:
        rows.unpersist()
    blocks = spark.read.schema("block long, x binary, y binary").parquet(path)
    top, gained = grow_top(blocks, n, width, classes, trees, some, depth, seed, whole)
    # a task reads about 32 MB of dealt rows, two thirds of all for a tree
    dealt = max(4 * cores, n * trees * width // (48 << 20))
    pieces = scratch_path(spark, "forest-pieces")
    write_pieces(blocks, top, n, width, classes, trees, some, depth, seed, dealt, pieces)
    for tree, part in _gained(spark, pieces, width):
        gained[tree] += part
    shares = gained / np.maximum(gained.sum(axis=1, keepdims=True), 1e-300)
    total = shares.sum(axis=0)
    return PieceForest(pieces, top, ends, classes, trees, (total / total.sum() if total.sum() else total).tolist(), features_col,
                       _files(spark, pieces))


def _gained(spark, path: str, width: int) -> list[tuple[int, np.ndarray]]:
    def add_up(table: pa.Table) -> pa.Table:
        part = sum(np.frombuffer(b.as_buffer(), float) for b in table["gained"])
        return pa.table({"tree": table["tree"][:1], "gained": pa.array([part.tobytes()], pa.binary())})
    found = spark.read.parquet(path).select("tree", "gained").groupBy("tree").applyInArrow(add_up, "tree int, gained binary").collect()
    return [(r["tree"], np.frombuffer(r["gained"], float)) for r in found]


def _files(spark, path: str) -> list[str]:
    """The files of a written table, as addresses that pyarrow opens."""
    found = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").collect()
    return [r["f"] if "://" in r["f"] else "file://" + r["f"].removeprefix("file:") for r in found]


class PieceForest:
    """The forest: its top in memory, the trees below on shared storage."""

    def __init__(self, path: str, top: Top, ends: list[list[float]], classes: int, trees: int, importances: list[float],
                 features_col: str, files: list[str]):
        self.path, self.top, self.ends, self.classes, self.trees = path, top, ends, classes, trees
        self.feature_importances, self.features_col, self.files = importances, features_col, files

    def transform(self, df: DataFrame) -> DataFrame:
        ends, classes, trees, files = self.ends, self.classes, self.trees, self.files
        feature, upto, left, leaves = self.top.feature, self.top.upto, self.top.left, self.top.leaves

        def votes(x: np.ndarray) -> np.ndarray:
            x = binned(x, ends)
            out, at = np.zeros((len(x), classes)), np.empty((trees, len(x)), np.int32)
            for t in range(trees):
                at[t] = walk(feature, upto, left, x, np.full(len(x), t))
                for node in np.unique(at[t][feature[at[t]] == -2]).tolist():
                    out[at[t] == node] += np.array(leaves[node]) / sum(leaves[node])
            for file in files:
                fs, p = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(p) as f:
                    for batch in pq.ParquetFile(f).iter_batches(16, columns=["tree", "node", "feature", "upto", "left", "mixed"]):
                        for t, node, *parts in zip(batch["tree"].to_pylist(), batch["node"].to_pylist(),
                                                   *(batch[c] for c in ("feature", "upto", "left", "mixed"))):
                            who = np.flatnonzero(at[t] == node)
                            if not len(who):
                                continue
                            ft, up, lf, mixed = (np.frombuffer(p.as_buffer(), d)
                                                 for p, d in zip(parts, (np.int16, np.uint8, np.int32, np.int32)))
                            end = walk(ft, up, lf, x[who], np.zeros(len(who), np.int32))
                            one = ft[end] == -1
                            out[who[one], lf[end[one]]] += 1
                            if not one.all():
                                counts = mixed.reshape(-1, classes)[lf[end[~one]]]
                                out[who[~one]] += counts / counts.sum(axis=1, keepdims=True)
            return out

        @F.pandas_udf("array<double>")
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def scored(held):
                x = np.stack([v for s in held for v in s.to_numpy()]).astype(float)
                return pd.Series(list(votes(x)), dtype=object)
            held = []  # batches scored together, as the trees are read for each time
            for s in batches:
                if len(s):
                    held.append(s)
                if sum(map(len, held)) >= SCORED:
                    yield scored(held)
                    held = []
            if held:
                yield scored(held)

        out = df.withColumn("__raw", raw(vector_to_array(self.features_col)))
        best = F.array_position("__raw", F.array_max("__raw")) - 1
        return (out.withColumn("rawPrediction", array_to_vector("__raw"))
                .withColumn("probability", array_to_vector(F.transform("__raw", lambda v: v / float(trees))))
                .withColumn("prediction", best.cast("double")).drop("__raw"))

    def document(self) -> dict:
        t = self.top
        return {"feature": t.feature.tolist(), "upto": t.upto.tolist(), "left": t.left.tolist(), "leaves": list(t.leaves.items()),
                "ends": self.ends, "classes": self.classes, "trees": self.trees, "importances": self.feature_importances,
                "features_col": self.features_col}

    @classmethod
    def from_document(cls, spark, doc: dict, path: str) -> PieceForest:
        top = Top(0)
        top.feature, top.upto, top.left = (np.array(doc[c], np.int32) for c in ("feature", "upto", "left"))
        top.leaves = {int(k): v for k, v in doc["leaves"]}
        return cls(path, top, doc["ends"], doc["classes"], doc["trees"], doc["importances"], doc["features_col"], _files(spark, path))
