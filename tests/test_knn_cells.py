import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import knn as K


def clusters(rng, n, dim=6, groups=12):
    centres = rng.normal(size=(groups, dim)) * 20
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))


def table(spark, x, y=None, first=0):
    rows = [(first + i, [float(v) for v in r], int(y[i]) if y is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, y int")


def brute(tr, te, y, k):
    out = []
    for q in te:
        near = np.lexsort((np.arange(len(tr)), ((tr - q) ** 2).sum(axis=1)))[:k]
        out.append(int(np.bincount(y[near]).argmax()))
    return out


@pytest.mark.parametrize("block_rows,k", [(10_000, 5), (90, 5), (90, 1), (37, 40)])
def test_cells_give_the_exact_neighbours_with_less_work(spark, block_rows, k):
    rng = np.random.default_rng(k)
    tr, te = clusters(rng, 800), np.concatenate([clusters(np.random.default_rng(9), 50), rng.normal(size=(10, 6)) * 40])
    tr[300:500] = tr[0]  # a hot point: more equal rows than a block or a cell holds
    y = rng.integers(0, 4, 800)
    model = K.fit_knn(table(spark, tr, y), "x", "y", "id", k=k, block_rows=block_rows)
    assert len(model.cells.files) >= 800 // block_rows and len(model.cells.pivots) == 28
    out = model.transform(table(spark, te, first=1000).repartition(3), compared_col="compared").collect()
    assert [r["predicted_label"] for r in sorted(out, key=lambda r: r["id"])] == brute(tr, te, y, k)
    if k <= 5:
        assert sum(r["compared"] for r in out) < 0.5 * len(te) * len(tr)


def test_duplicates_ties_and_few_rows(spark):
    tr = np.array([[0.0, 0.0]] * 30 + [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]])
    y = np.arange(len(tr)) % 3
    te = np.array([[0.0, 0.0], [0.5, 0.5], [1e6, 1e6], [1.0, 0.0]])
    for k in (1, 3, 34, 50):
        model = K.fit_knn(table(spark, tr, y), "x", "y", "id", k=k, block_rows=8)
        got = sorted(model.transform(table(spark, te)).collect(), key=lambda r: r["id"])
        assert [r["predicted_label"] for r in got] == brute(tr, te, y, k)
    one = K.fit_knn(table(spark, tr[:1], y), "x", "y", "id", k=5).transform(table(spark, te)).collect()
    assert {r["predicted_label"] for r in one} == {0}


def test_embeddings_need_a_part_of_the_work(spark):
    import os
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no driver tables here")
    d = spark.read.parquet(path).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"),
                                        F.col("label").alias("y"))
    model = K.fit_knn(d.where("id % 5 > 0"), "x", "y", "id")
    test = d.where("id % 5 = 0")
    out = model.transform(test, compared_col="compared")
    n, work = test.count() * d.where("id % 5 > 0").count(), out.agg(F.sum("compared")).first()[0]
    print("compared", work, "of", n)
    assert work <= n


def test_memory_of_the_search_does_not_grow_with_the_batch():
    import tracemalloc

    import numpy as np
    import pandas as pd
    from strata.operators import knn as K
    rng = np.random.default_rng(1)
    pivots = rng.normal(size=(K.PIVOTS, 8))
    x = pd.Series(list(rng.normal(size=(10_000, 8))))  # rows of an Arrow batch

    class Shared:
        value = K._Cells(pivots, [])
    home = K._home_cell(Shared, 8)
    tracemalloc.start()
    try:
        got = home(x)
        assert tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()
    d = np.sqrt(((np.stack(x.to_numpy()[:50])[:, None] - pivots) ** 2).sum(axis=2))
    assert (got["cell"].to_numpy()[:50] == d.argmin(axis=1)).all() and np.allclose(got["d"][:50], d.min(axis=1))
    tracemalloc.start()
    try:
        best, xt = K._Best(2_000, 5), rng.normal(size=(K.TILE_ROWS, 8))
        best.add(np.stack(x.to_numpy()[:2_000]), xt, np.arange(len(xt)), np.zeros(len(xt)))
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()
    assert np.isfinite(best.d).all()
