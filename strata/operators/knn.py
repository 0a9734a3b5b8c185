"""Exact k-nearest-neighbour scoring over pivot cells, without a cross join.

Fitting draws about sqrt(n) training rows as pivots (``PIVOTS`` at most) and gives every
row to the *cell* of its nearest pivot.  Rows are sorted by (cell, distance to the pivot)
and written to the shared scratch folder as parquet blocks, so a block holds a few cells,
or a ring of a large one.  The model keeps the pivots and, per block and cell, the smallest
and largest distance to the pivot: one small row for each.

Scoring is a ``mapInPandas`` over the query partitions, which reads blocks from shared
storage, never through the driver.  A query goes through two rounds:

1. the rings of its nearest cells that hold k rows give k neighbours, and so a bound;
2. every other ring is visited only if the triangle inequality allows a closer row in it:
   a row at distance r from its pivot is at least |d(query, pivot) - r| away.

A block without a ring to visit is not read.  With several blocks the queries are sorted
by cell, so a task needs few of them.  Distances are compared in tiles of ``QUERY_ROWS``
queries and ``TILE_ROWS`` rows (a few 8 MB tiles are alive at a time); a tile whose rows are
all too far from its centroid is skipped too.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import scratch_path

BLOCK_ROWS = 50_000
TILE_ROWS, QUERY_ROWS = 8_192, 128
#: most pivots, queries that are searched together, and nearest cells that the first round looks at
PIVOTS, SEARCH_ROWS, NEAREST = 1_024, 2_048, 8
#: share of the data's extent by which bounds are loosened, so that rounding never skips a tie
_SLACK = 1e-6


def _local_path(p: str) -> str:
    return p[len("file:"):] if p.startswith("file:") else p


class KNNModel:
    """k nearest training rows by Euclidean distance (ties: smaller id first).

    Classification: majority vote, smallest label on ties, probabilities are
    vote shares.  Regression: mean of the k labels."""

    def __init__(self, path: str, k: int, problem: str, dim: int, labels: list | None,
                 features_col: str, label_col: str, id_col: str, cells: "_Cells"):
        self.path, self.k, self.problem, self.dim = path, k, problem, dim
        self.cells = cells
        self.labels, self.features_col, self.label_col, self.id_col = labels, features_col, label_col, id_col

    def transform(self, df: DataFrame, query_id: str | None = None, prediction_col: str = "prediction",
                  compared_col: str | None = None) -> DataFrame:
        """The input rows (vector columns left out) + ``prediction`` (+
        ``probability`` as an array and ``predicted_label`` for classifiers).
        Rows pass through the scoring task, so no join back is needed.  ``compared_col``
        names a column for the number of training rows a query was compared with."""
        k, dim = self.k, self.dim
        problem, labels = self.problem, self.labels
        shared = df.sparkSession.sparkContext.broadcast(self.cells)
        from pyspark.ml.linalg import VectorUDT
        keep = [f for f in df.schema.fields if not isinstance(f.dataType, VectorUDT)
                and f.name not in ("__x", prediction_col, "probability", "predicted_label")]
        x = (vector_to_array(F.col(self.features_col), "float64") if _is_vector(df, self.features_col)
             else F.col(self.features_col).cast("array<double>"))
        qdf = df.select(*[F.col(f"`{f.name}`") for f in keep], x.alias("__x"))
        out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
        out_schema = (out_schema + ", " if out_schema else "") + f"`{prediction_col}` double"
        if problem == "classification":
            out_schema += ", probability array<double>"
        if compared_col:
            out_schema += f", `{compared_col}` long"
        if len(self.cells.files) > 1:
            home = F.pandas_udf(_home_cell(shared, dim), "cell int, d double")
            qdf = qdf.withColumn("__home", home("__x")).repartitionByRange("__home.cell", "__home.d").drop("__home")
        keep_names = [f.name for f in keep]

        def score(batches):
            for pdf in batches:
                if pdf.empty:
                    continue
                xq = np.stack(pdf["__x"].to_numpy()).astype("float64").reshape(len(pdf), dim)
                best = _Best(len(pdf), k)
                for at in range(0, len(pdf), SEARCH_ROWS):
                    shared.value.search(xq, np.arange(at, min(at + SEARCH_ROWS, len(pdf))), best, dim)
                best_d, best_y = best.d, best.y
                res = pdf[keep_names].copy()
                if problem == "classification":
                    votes = np.zeros((len(pdf), len(labels)))
                    for j in range(k):
                        valid = np.isfinite(best_d[:, j])
                        votes[np.arange(len(pdf))[valid], best_y[valid, j].astype(int)] += 1
                    res[prediction_col] = votes.argmax(axis=1).astype("float64")  # ties → smallest label
                    res["probability"] = list(votes / np.maximum(votes.sum(axis=1, keepdims=True), 1))
                else:
                    res[prediction_col] = np.nanmean(np.where(np.isfinite(best_d), best_y, np.nan), axis=1)
                if compared_col:
                    res[compared_col] = best.compared
                yield res

        scored = qdf.mapInPandas(score, out_schema)
        if problem == "classification":
            back = F.create_map(*[v for i, lab in enumerate(labels) for v in (F.lit(float(i)), F.lit(lab))])
            scored = scored.withColumn("predicted_label", back[F.col(prediction_col)])
        return scored


class _Best:
    """The k nearest training rows of every query so far (ties: the smaller id)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.d = np.full((n, k), np.inf)
        self.i = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.y = np.zeros((n, k))
        self.compared = np.zeros(n, np.int64)

    def add(self, xq: np.ndarray, xt: np.ndarray, ids: np.ndarray, ys: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Offer training rows to the queries ``rows`` (all of them if None)."""
        if not len(xt):
            return
        rows = np.arange(len(xq)) if rows is None else rows
        centre = xt.mean(axis=0)
        radius = np.sqrt(((xt - centre) ** 2).sum(axis=1).max())
        norm = (xt * xt).sum(axis=1)[None, :]
        for at in range(0, len(rows), QUERY_ROWS):
            some = rows[at:at + QUERY_ROWS]
            q = xq[some]
            # the slack keeps rounding from skipping a tie
            nearest = np.sqrt(((q - centre) ** 2).sum(axis=1)) * (1 - 1e-9) - radius * (1 + 1e-9)
            live = np.flatnonzero(np.maximum(nearest, 0.0) ** 2 <= self.d[some, -1] * (1 + 1e-9))
            if not len(live):
                continue
            q, some = q[live], some[live]
            self.compared[some] += len(xt)
            d = np.maximum((q * q).sum(axis=1)[:, None] + norm - 2.0 * q @ xt.T, 0.0)
            kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1] if d.shape[1] > self.k else np.full(len(q), np.inf)
            kth = np.minimum(kth, self.d[some, -1])
            row, col = np.nonzero(d <= kth[:, None])  # the k nearest of the tile and what ties with the last
            begin = np.searchsorted(row, np.arange(len(q) + 1))
            for r, where in enumerate(some):
                c = col[begin[r]:begin[r + 1]]
                if len(c):
                    dd, ii = np.concatenate([self.d[where], d[r, c]]), np.concatenate([self.i[where], ids[c]])
                    order = np.lexsort((ii, dd))[:self.k]
                    self.d[where], self.i[where] = dd[order], ii[order]
                    self.y[where] = np.concatenate([self.y[where], ys[c]])[order]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all pivots."""
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0.0))


class _Cells:
    """Pivots, and the rings of their cells in the blocks (file, cell, nearest and farthest row, rows)."""

    def __init__(self, pivots: np.ndarray, rings: list[tuple]):
        self.pivots = pivots
        self.files = sorted({f for f, *_ in rings})
        number = {f: i for i, f in enumerate(self.files)}
        rings = sorted((number[f], c, lo, hi, n) for f, c, lo, hi, n in rings)
        self.file = np.array([r[0] for r in rings], np.int64)
        self.cell = np.array([r[1] for r in rings], np.int64)
        self.lo, self.hi = np.array([r[2] for r in rings], float), np.array([r[3] for r in rings], float)
        self.rows = np.array([r[4] for r in rings], np.int64)
        self.of_file = np.searchsorted(self.file, np.arange(len(self.files) + 1))
        by = np.argsort(self.cell, kind="stable")
        self.by_cell, self.of_cell = by, np.searchsorted(self.cell[by], np.arange(len(pivots) + 1))
        self.extent = float(np.sqrt((pivots * pivots).sum(axis=1).max()) + self.hi.max()) if len(rings) else 0.0

    def _gap(self, ring: int, to_pivot: np.ndarray) -> np.ndarray:
        """Least possible distances of a ring's rows, from the distances to its pivot."""
        return np.maximum(np.maximum(to_pivot - self.hi[ring], self.lo[ring] - to_pivot), 0.0)

    def search(self, xq: np.ndarray, rows: np.ndarray, best: _Best, dim: int) -> None:
        """Put the nearest training rows of the queries ``rows`` into ``best``."""
        if not len(self.files):
            return
        to_pivot = _distances(xq[rows], self.pivots)
        slack = _SLACK * (self.extent + np.sqrt((xq[rows] ** 2).sum(axis=1)))
        seen: dict[int, np.ndarray] = {}
        loaded: dict[int, dict] = {}

        def visit(ring: int, who: np.ndarray) -> None:
            f = int(self.file[ring])
            if f not in loaded:
                loaded.clear()
                loaded[f] = _load(self.files[f], dim)
            x, ids, ys = loaded[f][int(self.cell[ring])]
            for t in range(0, len(x), TILE_ROWS):
                best.add(xq, x[t:t + TILE_ROWS], ids[t:t + TILE_ROWS], ys[t:t + TILE_ROWS], rows[who])

        wanted: dict[int, list[int]] = {}
        near = np.argsort(to_pivot, axis=1, kind="stable")[:, :NEAREST]
        for q, cells in enumerate(near.tolist()):
            have = 0
            for c in cells:
                rings = self.by_cell[self.of_cell[c]:self.of_cell[c + 1]]
                if not len(rings):
                    continue
                gaps = [float(self._gap(r, to_pivot[q, c])) for r in rings] if len(rings) > 1 else [0.0]
                ring = int(rings[int(np.argmin(gaps))])
                wanted.setdefault(ring, []).append(q)
                have += int(self.rows[ring])
                if have >= best.k:
                    break
        for ring in sorted(wanted):  # rings are numbered file by file
            seen[ring] = np.array(wanted[ring])
            visit(ring, seen[ring])
        for ring in range(len(self.file)):
            gap = self._gap(ring, to_pivot[:, self.cell[ring]]) - slack
            live = np.maximum(gap, 0.0) ** 2 <= best.d[rows, -1]
            if ring in seen:
                live[seen[ring]] = False
            if live.any():
                visit(ring, np.flatnonzero(live))


def _load(uri: str, dim: int) -> dict[int, tuple]:
    """Per cell (x, ids, labels) of a training block from shared storage (any file system
    pyarrow resolves from the URI: local, HDFS, object stores)."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    fs, p = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + _local_path(uri))
    with fs.open_input_file(p) as f:
        t = pq.read_table(f, columns=["id", "x", "y", "cell"])
    by = np.argsort(t["cell"].to_numpy(), kind="stable")
    cell, ids, ys = t["cell"].to_numpy()[by], t["id"].to_numpy()[by].astype(np.int64), t["y"].to_numpy()[by].astype("float64")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    x, at = np.empty((len(by), dim)), 0
    for part in t["x"].chunks:  # one copy of the vectors, of which the cells are slices
        x[place[at:at + len(part)]] = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
        at += len(part)
    ends = np.flatnonzero(np.diff(cell, append=-1)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    return {int(cell[a]): (x[a:z], ids[a:z], ys[a:z]) for a, z in zip(starts, ends)}


def _home_cell(shared, dim: int):
    """Nearest pivot of every query, and the distance to it."""
    def home(x: pd.Series) -> pd.DataFrame:
        pivots = shared.value.pivots
        if not len(x):
            return pd.DataFrame({"cell": [], "d": []})
        cell, near = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), QUERY_ROWS):  # distances to all pivots are alive for a few rows only
            some = slice(at, min(at + QUERY_ROWS, len(x)))
            d = _distances(np.stack(x.iloc[some].to_numpy()).astype("float64").reshape(-1, dim), pivots)
            cell[some], near[some] = d.argmin(axis=1), d.min(axis=1)
        return pd.DataFrame({"cell": cell, "d": near})
    return home


def open_cells(spark, path: str) -> _Cells:
    """The index of a written model: its pivots, and the rings of its blocks found in one scan."""
    pivots = [r["x"] for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()]
    rings = (spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("f"), "cell")
             .agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).collect())
    return _Cells(np.array(pivots, "float64").reshape(len(pivots), -1), [tuple(r) for r in rings])


def write_cells(rows: DataFrame, pivots: DataFrame, path: str, blocks: int | None = None) -> None:
    """Training rows (id, x, y, cell, d) as blocks sorted by cell and distance, and the pivots (cell, x)."""
    if blocks is not None:
        rows = rows.repartitionByRange(blocks, "cell", "d", "id").sortWithinPartitions("cell", "d", "id")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    pivots.coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")


def _is_vector(df: DataFrame, c: str) -> bool:
    from pyspark.ml.linalg import VectorUDT
    return isinstance(df.schema[c].dataType, VectorUDT)


def fit_knn(train: DataFrame, features_col: str, label_col: str, id_col: str, k: int = 5,
            problem: str = "classification", block_rows: int = BLOCK_ROWS) -> KNNModel:
    """Write the training rows as parquet blocks of about block_rows rows to the
    shared folder, sorted by pivot cell (labels indexed in sorted order for classification)."""
    x = (vector_to_array(F.col(features_col), "float64") if _is_vector(train, features_col)
         else F.col(features_col).cast("array<double>"))
    labels = None
    if problem == "classification":
        labels = sorted(r[0] for r in train.select(label_col).distinct().collect())
        index = F.create_map(*[v for i, lab in enumerate(labels) for v in (F.lit(lab), F.lit(float(i)))])
        y = index[F.col(label_col)]
    else:
        y = F.col(label_col).cast("double")
    rows = train.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), y.alias("y"))
    n = rows.count()
    spark = train.sparkSession
    path = scratch_path(spark, "knn-train")
    # a draw over all rows, the same whatever their partitions; at most PIVOTS vectors
    drawn = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, int(n ** 0.5)))).collect()
    dim = len(drawn[0]["x"]) if drawn else 0
    pivots = spark.createDataFrame([(i, r["x"]) for i, r in enumerate(drawn)], "cell int, x array<double>")
    shared = spark.sparkContext.broadcast(_Cells(np.array([r["x"] for r in drawn], "float64").reshape(len(drawn), dim), []))
    home = F.pandas_udf(_home_cell(shared, dim), "cell int, d double")
    write_cells(rows.withColumn("h", home("x")).select("id", "x", "y", "h.cell", "h.d"), pivots, path,
                max(1, -(-n // block_rows)))
    return KNNModel(path, k, problem, dim, labels, features_col, label_col, id_col, open_cells(spark, path))
