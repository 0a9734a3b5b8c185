"""Linear support vector machines of many classes, one against the rest, from shared passes.

Spark ML fits a one-vs-rest classifier as one ``LinearSVC`` per class, each with a copy of
the rows and a job for every loss that its search asks for: hundreds for a class.  All
machines see the same rows, so here they ask together.  A pass reads every row once, as
blocks of a matrix, and returns loss and gradient of every machine at all points that it
asks for; the steps that its line search may try next are asked for with the current one.

The machines are Spark ML's: hinge loss, an L2 penalty on the coefficients in the features'
own scale, a search on standardised features by OWL-QN without an L1 part, and the same
rules for steps and for when to stop.  A pass returns (features + 2) numbers per task and
point, and the driver holds ten past steps per machine.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a block; bytes of blocks in a partition, at least where cores can idle and at most
BLOCK_ROWS, LEAST_BYTES, MOST_BYTES = 512, 8 << 20, 128 << 20
#: most coefficients (classes x features) that are searched together
MOST_COEFFICIENTS = 1 << 17
#: past steps that describe the curvature; past losses that tell whether a search still gains
MEMORY, VALUES = 10, 20
#: tries of a line search, and how far a step may shrink or grow
TRIES, LEAST_STEP, MOST_STEP, GROW = 19, 1e-10, 1e10, 2.1


class _NoStep(Exception):
    """A line search left its bounds, or a curvature cannot be used."""


def _direction(g: np.ndarray, steps: list, deltas: list) -> np.ndarray:
    """Downhill by the inverse curvature of past steps (newest first), without the parts that lead uphill."""
    scale = 1.0
    if steps:
        sy, yy = steps[0] @ deltas[0], deltas[0] @ deltas[0]
        if not sy >= 0 or yy == 0:
            raise _NoStep
        scale = sy / yy
    d, shares = g.copy(), []
    for s, y in zip(steps, deltas):
        shares.append((s @ d) / (s @ y))
        d -= shares[-1] * y
    if not np.isfinite(shares).all():
        raise _NoStep
    d *= scale
    for s, y, a in zip(reversed(steps), reversed(deltas), reversed(shares)):
        d += (a - (y @ d) / (s @ y)) * s
    return np.where(d * g > 0, -d, 0.0)


def _step(x: np.ndarray, move: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """``x + move``; coefficients that would change their sign become 0."""
    to = x + move
    return np.where(np.sign(to) == signs, to, 0.0)


def search(size: int, max_iter: int, tol: float) -> Generator[list[np.ndarray], list[tuple[float, np.ndarray]], np.ndarray]:
    """The minimum of a convex function: yields lists of points, is sent value and gradient at each, returns the point."""
    x = np.zeros(size)
    f, g = (yield [x])[0]
    first, values, steps, deltas, rounds, failed = abs(f), [np.inf], [], [], 0, False
    while rounds < max_iter and np.sqrt(g @ g) > max(tol * abs(f), 1e-8) \
            and not (len(values) >= 2 and abs(f - max(values)) <= tol * first):
        try:
            d = _direction(g, steps, deltas)
            signs = np.where(x != 0, np.sign(x), np.sign(-g))
            slope, shrink = d @ g, 0.5 if rounds else 0.1
            at, known = 0.5 if rounds else 0.05 / np.sqrt(g @ g), {}
            for left in range(TRIES - 1, -1, -1):
                if at not in known:
                    ahead = [at, at * shrink, at * shrink * shrink, at * GROW]
                    points = [_step(x, a * d, signs) for a in ahead]
                    known |= zip(ahead, zip(points, (yield points)))
                to, (value, gradient) = known[at]
                along = gradient @ d
                if value > f + at * slope * 1e-4:
                    by = shrink
                elif along < 0.9 * slope:
                    by = GROW
                elif along > -0.9 * slope:
                    by = shrink
                else:
                    break
                if not left:  # the last try is taken as it is
                    break
                if not LEAST_STEP <= at * by <= MOST_STEP:
                    raise _NoStep
                at *= by
        except _NoStep:
            if failed:
                break
            steps, deltas, failed = [], [], True
            continue
        steps, deltas = [to - x, *steps][:MEMORY], [gradient - g, *deltas][:MEMORY]
        x, f, g, failed, rounds = to, value, gradient, False, rounds + 1
        values = [*values, f][-VALUES:]
    return x


def _blocks(df: DataFrame, features_col: str, label_col: str, rows: int, dim: int) -> RDD:
    """Pairs of a matrix of features and its labels, of at most ``BLOCK_ROWS`` rows, dealt evenly.

    An RDD, as its kept blocks go to Python as they are: a pass over them costs no conversion and no planning."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(x) != batch.num_rows * dim or not np.isfinite(x).all():
                raise ValueError("features must be vectors of one length without null, NaN or infinite values")
            x, y = x.reshape(-1, dim), batch.column(1).to_numpy(zero_copy_only=False)
            at = range(0, batch.num_rows, BLOCK_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([v[i:i + BLOCK_ROWS].tobytes() for i in at], pa.binary())
                                              for v in (x, y)], ["x", "y"])

    size = rows * dim * 8
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), -(-size // MOST_BYTES), 1)
    return df.select(vector_to_array(F.col(features_col)), F.col(label_col).cast("double")) \
        .mapInArrow(pack, "x binary, y binary").repartition(parts) \
        .rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(-1, dim), np.frombuffer(r["y"])))


def _sums(blocks: RDD, classes: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column of ``w`` (class ``classes`` against the rest): the loss, its slope by ``w`` and by ``b``,
    summed over all rows."""
    dim = len(w)

    def add_up(part: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        total = np.zeros((dim + 2, len(b)))
        for x, y in part:
            side = np.where(y[:, None] == classes, 1.0, -1.0)
            short = 1.0 - side * (x @ w + b)
            pull = np.where(short > 0, -side, 0.0)
            total[:dim] += x.T @ pull
            total[dim] += pull.sum(axis=0)
            total[dim + 1] += np.maximum(short, 0.0).sum(axis=0)
        yield total

    total = sum(blocks.mapPartitions(add_up).collect())
    return total[dim + 1], total[:dim], total[dim]


class Machines:
    """One linear machine per class; ``transform`` adds their margins and the class of the largest."""

    def __init__(self, weights: np.ndarray, intercepts: np.ndarray, features_col: str):
        self.weights, self.intercepts, self.features_col = weights, intercepts, features_col

    def transform(self, df: DataFrame) -> DataFrame:
        w, b = self.weights.T.copy(), self.intercepts

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(x), BLOCK_ROWS):
                out.extend(np.stack(x.iloc[at:at + BLOCK_ROWS].to_numpy()) @ w + b)
            return pd.Series(out, dtype=object)
        m = vector_to_array("rawPrediction")
        return df.withColumn("rawPrediction", array_to_vector(margins(vector_to_array(F.col(self.features_col))))) \
            .withColumn("prediction", (F.array_position(m, F.array_max(m)) - 1).cast("double"))

    def document(self) -> dict:
        return {"weights": self.weights.tolist(), "intercepts": self.intercepts.tolist(), "features_col": self.features_col}

    @classmethod
    def from_document(cls, doc: dict) -> "Machines":
        return cls(np.array(doc["weights"], float), np.array(doc["intercepts"], float), doc["features_col"])


def fit_machines(df: DataFrame, features_col: str, label_col: str, classes: int, reg: float, max_iter: int = 100,
                 tol: float = 1e-6) -> Machines | None:
    """The machines of classes 0 .. ``classes`` - 1, or None where these are too many coefficients to search together.

    ``df`` has rows."""
    row = df.select(Summarizer.metrics("count", "mean", "std").summary(F.col(features_col)).alias("s")).select("s.*").first()
    if classes * (len(row["mean"]) + 1) > MOST_COEFFICIENTS:
        return None
    n, mean, std = row["count"], row["mean"].toArray(), row["std"].toArray()
    inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    blocks = _blocks(df, features_col, label_col, n, len(mean)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        searches = [search(len(mean) + 1, max_iter, tol) for _ in range(classes)]
        asked, found = {c: next(s) for c, s in enumerate(searches)}, {}
        while asked:
            points = np.stack([p for ps in asked.values() for p in ps])
            of = np.array([c for c, ps in asked.items() for _ in ps], float)
            # points are of standardised features, the blocks hold them as they are
            w = points[:, :-1] * inverse
            loss, by_w, by_b = _sums(blocks, of, w.T.copy(), points[:, -1] - w @ mean)
            values = loss / n + 0.5 * reg * (w * w).sum(axis=1)
            slopes = np.column_stack([(by_w.T - np.outer(by_b, mean)) * inverse / n + reg * w * inverse, by_b / n])
            answers, later = iter(zip(values, slopes)), {}
            for c, ps in asked.items():
                try:
                    later[c] = searches[c].send([next(answers) for _ in ps])
                except StopIteration as end:
                    found[c] = end.value
            asked = later
    finally:
        blocks.unpersist()
    best = np.stack([found[c] for c in range(classes)])
    weights = best[:, :-1] * inverse
    return Machines(weights, best[:, -1] - weights @ mean, features_col)
