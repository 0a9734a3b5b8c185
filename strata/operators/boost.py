"""Gradient boosting of more than two classes on the multinomial deviance.

One model for all classes: every round takes the gradients of the same softmax, grows
one Spark regression tree per class on them, side by side, and replaces the leaves'
means by one Newton step (Friedman's leaf values) that a single aggregate over all
trees gives.  A row's margins are a column; lineage is cut by a reliable checkpoint
every ``checkpoint_every`` rounds.  What reaches the driver is the trees and two sums
per leaf.

The fitted model holds the trees as small arrays and adds their values up in Arrow
batches, so scoring is one projection however many rounds there are.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir

#: trees of one round that grow at the same time
TREE_THREADS = 8
#: the smallest share a class starts from, and the smallest curvature of a leaf
LEAST_SHARE, LEAST_CURVATURE = 1.1920929e-07, 1e-150


def softmax(margins: Column) -> Column:
    """Probabilities of an array of margins."""
    most = F.array_max(margins)
    ex = F.transform(margins, lambda x: F.exp(x - most))
    both = F.array(F.struct(ex.alias("e"), F.aggregate(ex, F.lit(0.0), lambda a, e: a + e).alias("t")))
    return F.transform(both, lambda b: F.transform(b["e"], lambda x: x / b["t"]))[0]  # the total is added up once


def tree_document(model) -> dict:
    """Nodes of a fitted Spark tree, root first: a split, or the number of a leaf.

    Leaves are numbered from left to right, as ``leafCol`` numbers them."""
    nodes: list[dict] = []
    leaves = 0

    def add(node) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append({})
        if node.subtreeDepth() == 0:
            nodes[at] = {"leaf": leaves}
            leaves += 1
            return at
        split = node.split()
        doc = {"feature": split.featureIndex()}
        if split.getClass().getSimpleName() == "ContinuousSplit":
            doc["upto"] = split.threshold()
        else:
            doc["among"] = list(split.leftCategories())
        doc["left"] = add(node.leftChild())
        doc["right"] = add(node.rightChild())
        nodes[at] = doc
        return at

    add(model._java_obj.rootNode())
    return {"nodes": nodes, "leaves": leaves}


def leaf_sql(tree: dict, features: str, at: int = 0) -> str:
    """SQL for the number of the leaf that a row (an array column) falls into."""
    node = tree["nodes"][at]
    if "leaf" in node:
        return str(node["leaf"])
    value = f"{features}[{node['feature']}]"
    test = (f"{value} <= double('{node['upto']!r}')" if "upto" in node
            else f"{value} IN ({', '.join(f'double({v!r})' for v in node['among']) or 'NULL'})")
    return (f"CASE WHEN {test} THEN {leaf_sql(tree, features, node['left'])} "
            f"ELSE {leaf_sql(tree, features, node['right'])} END")


def tree_values(tree: dict, x: np.ndarray) -> np.ndarray:
    """The tree's value for every row of ``x``."""
    out = np.empty(len(x))

    def go(at: int, rows: np.ndarray) -> None:
        node = tree["nodes"][at]
        if "leaf" in node:
            out[rows] = tree["values"][node["leaf"]]
            return
        v = x[rows, node["feature"]]
        left = v <= node["upto"] if "upto" in node else np.isin(v, node["among"])
        go(node["left"], rows[left])
        go(node["right"], rows[~left])

    go(0, np.arange(len(x)))
    return out


class SoftmaxBoost:
    """Boosted trees for ``classes`` classes; labels are 0 .. classes - 1."""

    def __init__(self, classes: int, max_iter: int = 100, step: float = 0.1, max_depth: int = 3, seed: int = 42,
                 checkpoint_every: int = 10, **tree):
        self.classes, self.rounds, self.step, self.seed, self.every = classes, max_iter, step, seed, checkpoint_every
        self.tree = dict(maxDepth=max_depth, impurity="variance") | tree

    def fit(self, df: DataFrame, features_col: str = "features", label_col: str = "label",
            weight_col: str | None = None) -> SoftmaxBoosted:
        ensure_checkpoint_dir(df.sparkSession)
        k, classes = self.classes, range(self.classes)
        weight = F.lit(1.0) if weight_col is None else F.col(weight_col)
        df = df.withColumn("__w", weight)
        of_class = df.groupBy(F.col(label_col).cast("int").alias("c")).agg(F.sum("__w").alias("count")).collect()  # a row per class
        n = sum(r["count"] for r in of_class)
        share = {r["c"]: r["count"] / n for r in of_class}
        start = [math.log(min(max(share.get(c, 0.0), LEAST_SHARE), 1 - LEAST_SHARE)) for c in classes]

        def moved(margins: Column) -> list[Column]:
            own = F.transform(softmax(margins), lambda p, c: F.when(c == F.col(label_col), 1.0).otherwise(0.0) - p)
            return [F.col(features_col), F.col(label_col), F.col("__w"), margins.alias("__f"), own.alias("__g")]

        data = df.select(*moved(F.array(*[F.lit(s) for s in start]))).persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[list[dict]] = []
        gain = np.zeros(0)
        last = None

        @inheritable_thread_target(df.sparkSession)
        def grow(c):
            weighted = {} if weight_col is None else {"weightCol": "__w"}
            return R.DecisionTreeRegressor(featuresCol=features_col, labelCol="__y", seed=self.seed + len(trees),
                                           **weighted, **self.tree).fit(data.select(features_col, "__w", F.col("__g")[c].alias("__y")))

        with ThreadPoolExecutor(min(TREE_THREADS, k)) as pool:
            for at in range(self.rounds):
                models = list(pool.map(grow, classes))
                if last is not None:
                    last.unpersist()  # this round's rows are held by now
                docs = [tree_document(m) for m in models]
                leaves = F.expr(f"array({', '.join(leaf_sql(doc, '__x') for doc in docs)})")
                placed = data.withColumn("__x", vector_to_array(features_col)).withColumn("__l", leaves)
                g = F.abs(F.col("z.g"))
                sums = placed.select("__w", F.posexplode(F.arrays_zip(F.col("__l").alias("l"), F.col("__g").alias("g"))).alias("c", "z")).groupBy(
                    "c", F.col("z.l").alias("leaf")).agg(F.sum(F.col("__w") * F.col("z.g")).alias("g"),
                                                         F.sum(F.col("__w") * g * (1 - g)).alias("h")).collect()
                for doc in docs:
                    doc["values"] = [0.0] * doc["leaves"]
                for r in sums:
                    if abs(r["h"]) >= LEAST_CURVATURE:
                        docs[r["c"]]["values"][r["leaf"]] = (k - 1) / k * r["g"] / r["h"]
                trees.append(docs)
                found = np.array([m.featureImportances.toArray() for m in models]).sum(axis=0)
                gain = found if not len(gain) else gain + found
                if at + 1 == self.rounds:
                    break
                steps = F.expr("array(" + ", ".join(
                    "array(" + ", ".join(f"double('{self.step * v!r}')" for v in doc["values"]) + ")" for doc in docs) + ")")
                after = F.transform(F.arrays_zip(F.col("__f").alias("f"), F.col("__l").alias("l"), steps.alias("s")),
                                    lambda z: z["f"] + z["s"][z["l"]])
                new = placed.withColumn("__f", after).select(*moved(F.col("__f")))
                last = data
                data = (new.checkpoint(eager=True) if (at + 1) % self.every == 0
                        else new.persist(StorageLevel.MEMORY_AND_DISK))
        data.unpersist()
        if last is not None:
            last.unpersist()
        total = gain.sum()
        return SoftmaxBoosted(trees, start, self.step, features_col, (gain / total if total else gain).tolist())


class SoftmaxBoosted:
    """Fitted trees (rounds x classes), the margins they start from and the step."""

    def __init__(self, trees: list[list[dict]], start: list[float], step: float, features_col: str,
                 importances: list[float]):
        self.trees, self.start, self.step, self.features_col = trees, start, step, features_col
        self.feature_importances = importances

    def document(self) -> dict:
        return {"trees": self.trees, "start": self.start, "step": self.step, "features_col": self.features_col,
                "importances": self.feature_importances}

    @classmethod
    def from_document(cls, doc: dict) -> SoftmaxBoosted:
        return cls(doc["trees"], doc["start"], doc["step"], doc["features_col"], doc["importances"])

    def transform(self, df: DataFrame) -> DataFrame:
        trees, start, step = self.trees, self.start, self.step

        @F.pandas_udf("array<double>")
        def margins(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.array(features.tolist(), dtype=float)
            out = np.tile(np.array(start), (len(x), 1))
            for docs in trees:
                for c, tree in enumerate(docs):
                    out[:, c] += step * tree_values(tree, x)
            return pd.Series(list(out))

        out = df.withColumn("__f", margins(vector_to_array(F.col(self.features_col))))
        probability = softmax(F.col("__f"))
        prediction = (F.array_position(F.col("__f"), F.array_max("__f")) - 1).cast("double")
        return (out.withColumn("rawPrediction", array_to_vector(F.col("__f"))).withColumn("prediction", prediction)
                .withColumn("probability", array_to_vector(probability)).drop("__f"))
