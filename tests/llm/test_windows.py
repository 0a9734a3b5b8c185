import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import windows
from strata.llm.windows import remove_repeated_windows, window_hashes
from tests.llm.conftest import EDGE, make, prose


def brute(rows, window=20):
    split = [(i, t.encode().split() if t else []) for i, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    least, out = {}, []
    for k in order:
        i, w = split[k]
        v = -(1 << 63) if i is None else i
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            least[key] = min(least.get(key, v), v)
    for k in order:
        i, w = split[k]
        v = -(1 << 63) if i is None else i
        cover, own = [False] * len(w), set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if least[key] < v or key in own:
                cover[p:p + window] = [True] * window
            own.add(key)
        spans, p = [], 0
        while p < len(w):
            q = p
            while q < len(w) and cover[q]:
                q += 1
            if q > p:
                spans.append((p, q))
            p = max(q, p + 1)
        out.append((i, len(w), spans, b" ".join(x for x, c in zip(w, cover) if not c).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r[0], r["n_words"], [tuple(s) for s in r["removed"]], r["kept"]) for r in df.collect()], key=str)


def test_edge_rows_match_brute_force(spark):
    out = remove_repeated_windows(make(spark, EDGE).repartition(3))
    assert out.columns == ["doc_id", "n_words", "removed", "kept"]
    assert got(out) == brute(EDGE)


@pytest.mark.parametrize("window,run_bytes", [(20, 3000), (20, 1 << 20), (1, 3000), (7, 2000)])
def test_passages_match_brute_force(spark, window, run_bytes):
    rng = random.Random(window)
    passages = [prose(900 + k, 15 + 6 * k) for k in range(6)] + ["la la " * 30, "une à une " * 12, "one\ttwo\x0b three four " * 9]
    rows = []
    for i in range(80):
        parts = [prose(i * 10 + j, rng.randint(0, 15)) for j in range(4)]
        for p in rng.sample(passages, rng.randint(0, 3)):
            words = p.split(" ")
            parts.insert(rng.randint(0, 3), " ".join(words[rng.randint(0, 4):]))
        rows.append((rng.randrange(-10 ** 6, 10 ** 6), rng.choice([" ", "\n\n", "  "]).join(parts)))
    rows += [(5, rows[3][1]), (7, rows[3][1]), rows[4], (rows[5][0], "other text " + rows[6][1]), (None, rows[7][1])]
    assert got(remove_repeated_windows(make(spark, rows), window=window, run_bytes=run_bytes)) == brute(rows, window)


def test_repeats_inside_one_document_and_across_neighbours(spark):
    a, b = prose(1, 30), prose(2, 30)
    rows = [(1, a + " " + b + "\n" + a), (2, a), (3, b + " " + a), (4, " ".join(a.split()[:19])),
            (5, " ".join(a.split()[:20])), (6, " ".join(a.split()[:21]))]
    assert got(remove_repeated_windows(make(spark, rows))) == brute(rows)


def test_one_passage_in_all_documents(spark):
    passage = prose(3, 60)
    rows = [(i, prose(i + 100, 20) + " " + passage + " " + prose(i + 500, 20)) for i in range(300)]
    rows += [(None, passage)] * 5 + [(77, rows[77][1])] * 40
    assert got(remove_repeated_windows(make(spark, rows), run_bytes=5000)) == brute(rows)


def test_string_ids_go_by_their_bytes(spark):
    passage = prose(4, 30)
    rows = [("b", passage), ("a10", passage + " x"), ("a9", "y " + passage), ("é", passage)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = {r["doc_id"]: r["kept"] for r in remove_repeated_windows(docs).collect()}
    assert kept == {"a10": passage + " x", "a9": "y", "b": "", "é": ""}


def test_empty_table_and_arguments(no_docs):
    assert remove_repeated_windows(no_docs).count() == 0
    assert remove_repeated_windows(no_docs.withColumn("doc_id", F.lit("x"))).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_windows(no_docs, window=0)


def test_hash_depends_on_the_window_alone():
    words = np.array([5, 9, 9, 5, 7, 5, 9, 9, 5, 7], np.uint64)
    h = window_hashes(words, np.arange(8), 3, 0xD1342543DE82EF95)
    assert (h[:3] == h[5:]).all() and len(set(h.tolist())) == 5


def test_windows_that_share_the_first_hash_are_told_apart(monkeypatch):
    rows = sorted((i, prose(i % 9, 30, vocabulary=3) + " " + prose(i % 4, 25)) for i in range(40))
    weak = windows.window_hashes
    monkeypatch.setattr(windows, "window_hashes", lambda words, starts, window, base: weak(words, starts, window, base)
                        & np.uint64((1 << 64) - 1 if base != windows._BASES[1] else 7 << 60))
    ids = pa.array([i for i, _ in rows], pa.int64())
    run = windows.Run(pa.table({"_id": ids, "_num": ids, "_text": [t for _, t in rows]}), 20)
    found = run.candidates(np.zeros(len(run.counted()), bool))
    assert len(run.counted()) <= 8
    spans = run.removed(found, np.zeros(0, bool))
    assert spans == [s for _, _, s, _ in sorted(brute(rows), key=lambda r: r[0])]
