"""Trees over few binned features: rows become the cells of a grid.

A tree of Spark ML sees a feature only through at most ``maxBins`` bins.  Where few features
are split, the bins make a grid of a bounded number of cells, whatever the number of rows, and
all that a tree needs to know of a cell are its rows' count and the sum of their labels (for
classes: the rows of each).  So one pass adds the rows up by cell, and boosting works on a
weighted row per cell, with the trees it would grow on the rows: rows of one cell are never
parted, and their spread inside the cell takes no part in the gain of a split.  A forest draws
its bootstrap samples from the rows themselves, in the same pass (``forest_sums``).

Thresholds come from a sample of the size and by the rule that Spark ML uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: cells of the largest grid, and rows from which on a grid is made (fewer are fitted as they are)
MOST_CELLS, FROM_ROWS = 1 << 15, 200_000
#: bins of a feature and rows that say where they end: those of Spark ML's trees
BINS, SAMPLE = 32, 10_000


def thresholds(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Where the bins of a feature end: halfway between neighbours, else at about equal counts."""
    found, count = np.unique(values[~np.isnan(values)], return_counts=True)
    halfway = (found[1:] + found[:-1]) / 2
    if len(halfway) < bins:
        return halfway.tolist()
    stride, out = count.sum() / bins, []
    upto = np.cumsum(count)
    for i, half in enumerate(halfway):
        target = (len(out) + 1) * stride
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(float(half))
    return out


def bin_sql(value: str, ends: list[float], at: int = 0) -> str:
    """SQL for the number of ``ends`` below ``value`` (a value beyond all numbers is in the last bin)."""
    if not ends:
        return str(at)
    mid = len(ends) // 2
    return (f"CASE WHEN {value} <= double('{ends[mid]!r}') THEN {bin_sql(value, ends[:mid], at)} "
            f"ELSE {bin_sql(value, ends[mid + 1:], at + mid + 1)} END")


@dataclass
class Grid:
    ends: list[list[float]]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(e) + 1 for e in self.ends)

    def binned(self, df: DataFrame, features_col: str, out: str) -> DataFrame:
        """``df`` with the array of each row's bins."""
        parts = [bin_sql(f"__x[{i}]", e) for i, e in enumerate(self.ends)]
        return df.withColumn("__x", vector_to_array(features_col)).withColumn(
            out, F.expr(f"array({', '.join(parts)})")).drop("__x")

    def cell(self, bins: str) -> Column:
        """Number of the cell of an array of bins, the last feature varying fastest."""
        at = F.lit(0)
        for i, n in enumerate(self.shape):
            at = at * n + F.col(bins)[i]
        return at

    def bins_of_cells(self) -> np.ndarray:
        return np.stack([x.ravel() for x in np.indices(self.shape)], axis=1)


def make_grid(df: DataFrame, features_col: str, seed: int, from_rows: int | None = None) -> Grid | None:
    """The grid of the rows' features; none if they are few or it would have too many cells."""
    least = FROM_ROWS if from_rows is None else from_rows
    first = df.select(F.size(vector_to_array(features_col))).first()
    if first is None or not 0 < first[0] < MOST_CELLS.bit_length():  # a feature that is split has two bins
        return None
    n = df.count()
    if n < least:
        return None
    some = df.select(vector_to_array(features_col).alias("x"))
    if n > SAMPLE:
        some = some.sample(False, SAMPLE / n, seed)
    x = np.array([r["x"] for r in some.collect()], dtype=float)  # about SAMPLE rows
    if not len(x):
        return None
    grid = Grid([thresholds(x[:, j]) for j in range(x.shape[1])])
    return grid if np.prod(grid.shape, dtype=float) <= MOST_CELLS else None


# -- boosting: a weighted row for each cell ---------------------------------------------------

CELL_FEATURES, CELL_WEIGHT = "__cell_features", "__cell_weight"


def cell_rows(df: DataFrame, grid: Grid, features_col: str, label_col: str, classes: bool) -> DataFrame:
    """(features, label, weight) of the cells: mean labels, or a row per class."""
    rows = grid.binned(df.select(features_col, label_col), features_col, "__b").select("__b", label_col)
    n = F.count(F.lit(1)).cast("double").alias(CELL_WEIGHT)
    found = (rows.groupBy("__b", label_col).agg(n) if classes
             else rows.groupBy("__b").agg(n, F.avg(label_col).alias(label_col)))
    # few rows for a job per level of every tree: more tasks would only wait for each other
    return found.coalesce(4).select(
        array_to_vector(F.col("__b").cast("array<double>")).alias(CELL_FEATURES), label_col, CELL_WEIGHT)


class BinnedFitted:
    """A model fitted on bins; its rows are binned before it sees them."""

    def __init__(self, grid: Grid, fitted, features_col: str):
        self.grid, self.fitted, self.features_col = grid, fitted, features_col

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.grid.binned(df, self.features_col, "__b").withColumn(
            CELL_FEATURES, array_to_vector(F.col("__b").cast("array<double>"))).drop("__b")
        return self.fitted.transform(rows).drop(CELL_FEATURES)

    @property
    def feature_importances(self):
        return self.fitted.feature_importances


# -- forests: bootstrap sums of every cell and tree -------------------------------------------

def forest_sums(rows: DataFrame, cells: int, trees: int, seed: int) -> DataFrame:
    """Per task and tree: drawn rows and their label sum, of every cell, from rows (cell, label).

    So many rows as a Poisson number of the batch's mean are drawn from a batch, with
    replacement: every row comes a Poisson number of times, of mean one, as in Spark's forests.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        n, total = np.zeros((trees, cells)), np.zeros((trees, cells))
        for batch in batches:
            cell, y = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(cell):
                continue
            for t, size in enumerate(rng.poisson(len(cell), trees)):
                drawn = rng.integers(0, len(cell), size, dtype=np.int32)
                at = cell[drawn]
                n[t] += np.bincount(at, minlength=cells)
                total[t] += np.bincount(at, y[drawn], cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(trees), pa.int32()), pa.array([r.tobytes() for r in n], pa.binary()),
             pa.array([r.tobytes() for r in total], pa.binary())], ["tree", "n", "total"])

    return rows.mapInArrow(run, "tree int, n binary, total binary")


def grow(bins: np.ndarray, n: np.ndarray, total: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A regression tree over all cells, level by level: its value for each, and the gain of each feature.

    ``bins`` (cells x features), ``n`` and ``total`` the drawn rows and label sums of the cells."""
    gained = np.zeros(bins.shape[1])
    if not n.sum():
        return np.zeros(len(n)), gained
    mean = total.sum() / n.sum()
    total = total - mean * n  # about 0, so that little is lost when squares are subtracted
    node, open_ = np.zeros(len(n), np.int64), np.ones(1, bool)
    least = 1e-12 * (total ** 2 / np.maximum(n, 1)).sum()
    for _ in range(depth):
        k = len(open_)
        best, feature, upto = np.full(k, least), np.full(k, -1), np.zeros(k, np.int64)
        for f in range(bins.shape[1]):
            width = int(bins[:, f].max()) + 1
            at = node * width + bins[:, f]
            left_n = np.bincount(at, n, k * width).reshape(k, width).cumsum(axis=1)
            left = np.bincount(at, total, k * width).reshape(k, width).cumsum(axis=1)
            all_n, all_ = left_n[:, -1:], left[:, -1:]
            right_n, right = all_n - left_n, all_ - left
            gain = left ** 2 / np.maximum(left_n, 1) + right ** 2 / np.maximum(right_n, 1) - all_ ** 2 / np.maximum(all_n, 1)
            gain[(left_n == 0) | (right_n == 0)] = -1
            where = gain.argmax(axis=1)
            gain = gain[np.arange(k), where]
            better = (gain > best) & open_
            best[better], feature[better], upto[better] = gain[better], f, where[better]
        split = feature >= 0
        if not split.any():
            break
        np.add.at(gained, feature[split], best[split])
        right = bins[np.arange(len(node)), np.maximum(feature[node], 0)] > upto[node]
        used, node = np.unique(node * 2 + (right & split[node]), return_inverse=True)
        open_ = split[used // 2]  # a node that was not split stays a leaf
    sums, count = np.bincount(node, total), np.bincount(node, n)
    return (sums / np.maximum(count, 1) + mean)[node], gained


def fit_forest(df: DataFrame, grid: Grid, features_col: str, label_col: str, trees: int, depth: int, seed: int) -> GridForest:
    """Trees grown side by side, a task's group each; the mean of their values is the forest."""
    bins = grid.bins_of_cells()
    cells = len(bins)
    rows = grid.binned(df.select(features_col, label_col), features_col, "__b").select(
        grid.cell("__b").cast("int").alias("cell"), F.col(label_col).cast("double").alias("label"))
    # a task's sums are as large for few rows as for many
    tasks = min(256, 2 * df.sparkSession.sparkContext.defaultParallelism)
    sums = forest_sums(rows.coalesce(tasks), cells, trees, seed)

    def one(table: pa.Table) -> pa.Table:
        n, total = (sum(np.frombuffer(b.as_buffer(), float) for b in table[c]) for c in ("n", "total"))
        value, gain = grow(bins, n, total, depth)
        part = gain / gain.sum() if gain.sum() else gain
        return pa.table({"value": pa.array([value.tobytes()], pa.binary()), "part": pa.array([part.tolist()], pa.list_(pa.float64()))})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, part = np.zeros(cells), np.zeros(bins.shape[1])
        for batch in batches:
            for v, p in zip(batch.column(0), batch.column(1).to_pylist()):
                value, part = value + np.frombuffer(v.as_buffer(), float), part + p
        yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary()),
                                          pa.array([part.tolist()], pa.list_(pa.float64()))], ["value", "part"])

    ddl = "value binary, part array<double>"
    grown = sums.groupBy("tree").applyInArrow(one, ddl).coalesce(16).mapInArrow(add_up, ddl).collect()  # 16 rows at most
    value, part = (sum(np.frombuffer(r["value"], float) for r in grown), sum(np.array(r["part"]) for r in grown))
    return GridForest(grid, (value / trees).tolist(), (part / part.sum() if part.sum() else part).tolist(), features_col)


class GridForest:
    """A forest of regression trees as the mean of their values in every cell of the grid."""

    def __init__(self, grid: Grid, values: list[float], importances: list[float], features_col: str):
        self.grid, self.values, self.feature_importances, self.features_col = grid, values, importances, features_col

    def transform(self, df: DataFrame) -> DataFrame:
        values = np.array(self.values)

        @F.pandas_udf("double")
        def value(cell: pd.Series) -> pd.Series:
            return pd.Series(values[cell.to_numpy()])

        return (self.grid.binned(df, self.features_col, "__b").withColumn("prediction", value(self.grid.cell("__b").cast("int")))
                .drop("__b"))

    def document(self) -> dict:
        return {"ends": self.grid.ends, "values": self.values, "importances": self.feature_importances,
                "features_col": self.features_col}

    @classmethod
    def from_document(cls, doc: dict) -> GridForest:
        return cls(Grid(doc["ends"]), doc["values"], doc["importances"], doc["features_col"])
