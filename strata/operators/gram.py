"""Cross-validation of linear models from one scan.

Least squares, ridge, lasso and the elastic net need nothing of their rows but counts,
sums and cross products of features and target.  One scan adds these up per fold; the
training set of a fold is the total minus that fold, so the fits of all folds and all
candidate parameters, and their scores on the held-out rows, come from the same sums and
no further job.  A task adds up its own rows, the sums of one matrix row and fold meet in
one group, and (features + 2)^2 numbers per fold reach the driver.

Parameters and objectives are scikit-learn's: ridge minimises |y - Xw|^2 + alpha |w|^2,
lasso and elastic net |y - Xw|^2 / (2n) + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2),
all with an intercept that is not penalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = ("linear", "ridge", "lasso", "elastic_net")


def fold_sums(df: DataFrame, features_col: str, target: str, fold: Column) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Per fold the cross products of (1, features, target), less a shift that is returned with them.

    Rows with a null in the target, the fold or any feature are left out.
    """
    x = vector_to_array(features_col) if isinstance(df.schema[features_col].dataType, VectorUDT) \
        else F.col(features_col).cast("array<double>")
    rows = df.select(fold.cast("int").alias("fold"), F.concat(x, F.array(F.col(target).cast("double"))).alias("v")) \
        .where("fold IS NOT NULL AND v IS NOT NULL AND NOT exists(v, e -> e IS NULL OR isnan(e))")
    first = rows.select("v").first()  # sums around a value of the data cancel less
    if first is None:
        return {}, np.zeros(0)
    shift = np.array(first["v"])

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for k, v in part.groupby("fold")["v"]:
                z = np.concatenate([np.ones((len(v), 1)), np.stack(v.to_numpy()) - shift], axis=1)
                total[k] = total.get(k, 0.0) + z.T @ z
        for k, m in total.items():
            yield pd.DataFrame({"fold": k, "i": np.arange(len(m)), "sums": list(m)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "i": pdf["i"].iloc[:1],
                             "sums": [np.stack(pdf["sums"].to_numpy()).sum(axis=0)]})

    schema = "fold int, i int, sums array<double>"
    out: dict[int, np.ndarray] = {}
    for r in rows.mapInPandas(add_up, schema).groupBy("fold", "i").applyInPandas(merge, schema).collect():
        out.setdefault(r["fold"], np.zeros((len(shift) + 1,) * 2))[r["i"]] = r["sums"]
    return out, shift


def solve(sums: np.ndarray, model: str = "linear", alpha: float = 1.0, l1_ratio: float = 0.5,
          max_iter: int = 10_000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (both of shifted values) from the cross products of a training set."""
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    centred = sums[1:, 1:] - n * np.outer(mean, mean)
    gram, xy = centred[:-1, :-1], centred[:-1, -1]
    if model == "linear":
        w = np.linalg.lstsq(gram, xy, rcond=1e-12)[0]
    elif model == "ridge":
        w = np.linalg.solve(gram + alpha * np.eye(len(gram)), xy) if alpha > 0 else np.linalg.lstsq(gram, xy, rcond=1e-12)[0]
    elif model in ("lasso", "elastic_net"):
        l1 = alpha * (1.0 if model == "lasso" else l1_ratio)
        l2 = 0.0 if model == "lasso" else alpha * (1.0 - l1_ratio)
        gram, xy = gram / n, xy / n
        w, scale = np.zeros(len(gram)), np.diag(gram) + l2
        for _ in range(max_iter):
            moved = 0.0
            for j in np.flatnonzero(scale > 0):
                pull = xy[j] - gram[j] @ w + gram[j, j] * w[j]
                new = np.sign(pull) * max(abs(pull) - l1, 0.0) / scale[j]
                moved, w[j] = max(moved, abs(new - w[j]) * np.sqrt(gram[j, j])), new
            if moved <= tol * max(1.0, np.sqrt(centred[-1, -1] / n)):
                break
    else:
        raise ValueError(f"unknown model {model!r}; one of {', '.join(MODELS)}")
    return w, float(mean[-1] - mean[:-1] @ w)


def _scores(sums: np.ndarray, w: np.ndarray, intercept: float) -> tuple[float, float]:
    """R2 and mean squared error on the rows of ``sums``."""
    c = np.concatenate([[-intercept], -w, [1.0]])
    error = max(float(c @ sums @ c), 0.0)
    n, spread = sums[0, 0], float(sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0])
    r2 = 1.0 - error / spread if spread > 0 else float(error == 0)
    return float(r2), float(error / n)


def cross_validate_linear(df: DataFrame, features_col: str, target: str, fold: Column,
                          candidates: list[dict]) -> DataFrame:
    """(candidate, model, alpha, l1_ratio, fold, rows, r2, mse): every candidate on every fold, from one scan.

    A candidate names ``model`` and its parameters, such as ``{"model": "ridge", "alpha": 2.0}``.
    Folds whose training set is empty are left out.
    """
    for c in candidates:
        if c.get("model", "linear") not in MODELS:
            raise ValueError(f"unknown model {c['model']!r}; one of {', '.join(MODELS)}")
    folds, _ = fold_sums(df, features_col, target, fold)
    total = sum(folds.values()) if folds else None
    rows = []
    for i, c in enumerate(candidates):
        for k, held in sorted(folds.items()):
            train = total - held
            if train[0, 0] < 0.5:
                continue
            w, b = solve(train, **c)
            r2, mse = _scores(held, w, b)
            rows.append((i, c.get("model", "linear"), float(c.get("alpha", 1.0)), float(c.get("l1_ratio", 0.5)), k,
                         int(round(held[0, 0])), r2, mse))
    return df.sparkSession.createDataFrame(rows, "candidate int, model string, alpha double, l1_ratio double, "
                                                 "fold int, rows long, r2 double, mse double")


def best_linear(scores: DataFrame) -> DataFrame:
    """One row per candidate with the mean scores over its folds, best R2 first."""
    return scores.groupBy("candidate", "model", "alpha", "l1_ratio").agg(
        F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"), F.avg("mse").alias("mean_mse")) \
        .orderBy(F.desc("mean_r2"), "candidate")


def fit_linear_sums(df: DataFrame, features_col: str, target: str, **candidate) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of one candidate on all rows."""
    folds, shift = fold_sums(df, features_col, target, F.lit(0))
    if not folds:
        raise ValueError("no complete rows to fit")
    w, b = solve(folds[0], **candidate)
    return w, float(b + shift[-1] - shift[:-1] @ w)
