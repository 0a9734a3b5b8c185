import random

import numpy as np
import pyarrow as pa
import pytest

from strata.llm.repeats import Run, remove_repeats
from strata.llm.runs import cut
from tests.llm.conftest import EDGE, make, prose


def brute(rows, window=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            k = b[p:p + window]
            v = -(1 << 63) if i is None else i
            first[k] = min(first.get(k, v), v)
    out = []
    for i, t in rows:
        b, v = (t or "").encode(), -(1 << 63) if i is None else i
        cover = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p:p + window]] < v:
                cover[p:p + window] = b"\1" * window
        spans, p = [], 0
        while p < len(b):
            if cover[p]:
                q = p
                while q < len(b) and cover[q]:
                    q += 1
                spans.append((p, q))
                p = q
            else:
                p += 1
        out.append((i, len(b), spans, bytes(x for x, c in zip(b, cover) if not c)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r[0], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in df.collect()], key=str)


def test_edge_rows_match_brute_force(spark):
    out = remove_repeats(make(spark, EDGE).repartition(3))
    assert out.columns == ["doc_id", "n_bytes", "removed", "kept"]
    assert got(out) == brute(EDGE)


@pytest.mark.parametrize("window,run_bytes", [(50, 3000), (50, 1 << 20), (16, 3000), (77, 2000)])
def test_passages_match_brute_force(spark, window, run_bytes):
    rng = random.Random(window)
    passages = [prose(900 + k, 6 + 5 * k) for k in range(6)] + ["à la carte " * 8, "z" * 70]
    rows = []
    for i in range(70):
        parts = [prose(i * 10 + j, rng.randint(0, 12)) for j in range(4)]
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 5)
            parts.insert(rng.randint(0, 3), p[cut:] if rng.random() < 0.5 else p)
        rows.append((rng.randrange(10 ** 6), rng.choice(["", " "]).join(parts)))
    rows += [(5, rows[3][1]), (7, rows[3][1]), (rows[4][0], rows[4][1]), (rows[5][0], "other text " + rows[6][1])]
    assert got(remove_repeats(make(spark, rows), window=window, run_bytes=run_bytes)) == brute(rows, window)


def test_touching_spans_of_neighbouring_documents(spark):
    a, b = prose(1, 30), prose(2, 30)
    rows = [(1, a + " " + b), (2, a), (3, b), (4, a[:49]), (5, a[:50]), (6, a[:51])]
    assert got(remove_repeats(make(spark, rows))) == brute(rows)


def test_one_passage_in_all_documents(spark):
    passage = prose(3, 60)
    rows = [(i, prose(i + 100, 20) + " " + passage + " " + prose(i + 500, 20)) for i in range(300)]
    assert got(remove_repeats(make(spark, rows), run_bytes=5000)) == brute(rows)


def test_empty_table_and_arguments(no_docs):
    assert remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(no_docs, window=8)


def test_copies_of_a_text_with_null_id(spark):
    text = prose(21, 40)
    rows = [(5, text), (None, text), (-7, text), (None, text), (9, "x" * 10 + text)]
    assert got(remove_repeats(make(spark, rows))) == brute(rows)


def test_first_digits_fill_the_buckets_alike():
    docs = pa.table({"id": pa.array(range(40), pa.int64()), "text": [prose(i, 2000) for i in range(40)]})
    digits = Run(docs, set(), 50).digits
    sizes = np.diff(cut(digits, 32))
    assert (digits[1:] > digits[:-1]).all() and len(digits) > 3200
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > sizes.mean() / 2
