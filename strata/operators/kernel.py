"""Landmark (Nyström) features of the radial kernel exp(-gamma |x - z|^2).

A kernel machine over n rows needs n x n kernel values.  With m landmarks, drawn from all
rows, each row is described by its m kernel values, turned by the landmarks' own kernel
matrix so that inner products of these features approximate the kernel (and equal it at
the landmarks).  A linear learner on them then is a kernel machine, trained in Spark over
any number of rows; the landmarks are all that leaves the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows drawn as landmarks, at most
LANDMARKS = 256
#: rows whose kernel values are computed together
_ROWS = 4_096


def scale_gamma(df: DataFrame, features_col: str) -> float:
    """1 / (features x variance of all entries), the usual default; 1 where nothing varies."""
    row = df.select(Summarizer.metrics("count", "mean", "normL2").summary(F.col(features_col)).alias("s")).select("s.*").first()
    if not row["count"]:
        return 1.0
    mean = row["mean"].toArray()
    squares = row["normL2"].toArray() ** 2 / row["count"]
    spread = float(squares.mean() - mean.mean() ** 2)
    return 1.0 / (len(mean) * spread) if spread > 1e-15 else 1.0


def draw_landmarks(df: DataFrame, features_col: str, most: int = LANDMARKS) -> np.ndarray:
    """At most ``most`` different rows in the order of a hash of their values: a draw over the
    distinct rows that does not depend on partitions."""
    x = df.select(vector_to_array(F.col(features_col)).alias("x")).distinct()
    rows = x.orderBy(F.xxhash64("x"), "x").limit(most).collect()
    return np.array([r["x"] for r in rows], float).reshape(len(rows), -1)


class KernelMap:
    """The feature map of fixed landmarks."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = landmarks, gamma
        values, vectors = np.linalg.eigh(self.kernel(landmarks))
        keep = values > max(values.max(initial=0.0), 1e-12) * 1e-10
        self.turn = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        z = self.landmarks
        d = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :] - 2.0 * x @ z.T
        return np.exp(-self.gamma * np.maximum(d, 0.0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.turn

    def transform(self, df: DataFrame, features_col: str, out_col: str) -> DataFrame:
        """``df`` with the kernel features as a vector column."""
        shared, dim = df.sparkSession.sparkContext.broadcast(self), self.landmarks.shape[1]

        @F.pandas_udf("array<double>")
        def features(x: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(x), _ROWS):
                rows = np.stack(x.iloc[at:at + _ROWS].to_numpy()).astype(float).reshape(-1, dim)
                out.extend(shared.value.apply(rows))
            return pd.Series(out, dtype=object)
        return df.withColumn(out_col, array_to_vector(features(vector_to_array(F.col(features_col)))))

    def document(self) -> dict:
        return {"landmarks": self.landmarks.tolist(), "gamma": self.gamma, "dim": self.landmarks.shape[1]}

    @classmethod
    def from_document(cls, doc: dict) -> "KernelMap":
        return cls(np.array(doc["landmarks"], float).reshape(-1, doc["dim"]), doc["gamma"])


def fit_kernel_map(df: DataFrame, features_col: str, gamma: float | str = "scale", landmarks: int = LANDMARKS) -> KernelMap:
    if gamma != "scale" and not (isinstance(gamma, (int, float)) and gamma > 0):
        raise ValueError("gamma must be 'scale' or a positive number")
    value = scale_gamma(df, features_col) if gamma == "scale" else float(gamma)
    return KernelMap(draw_landmarks(df, features_col, landmarks), value)
