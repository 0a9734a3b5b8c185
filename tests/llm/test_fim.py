import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import fim
from tests.llm.conftest import EDGE, make, prose


def brute(i, text, seed=1):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    sha = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(spark, rows):
    docs = make(spark, rows)
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n_tokens", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted((brute(i, t) for i, t in rows), key=str)
    back = out.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r[0], r[1]) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    return {r[2] for r in got}


def test_edge_rows_match_brute_force(spark):
    assert check(spark, EDGE + [(90, "a <P> b"), (91, "<S>"), (92, "x<M>"), (93, "< P >"), (94, "<"), (95, "><P")]) >= {"plain", "psm"}


def test_many_texts_match_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(50 + k, 400) + "\n" for k in range(4)] + ["Ж" * 700, "z" * 9000, "12 34\t" * 300, "日本 x" * 200]
    rows = [(i, "".join(rng.sample(shared, rng.randint(0, 4))) + prose(i, rng.randint(0, 40))) for i in range(200)]
    assert check(spark, rows) == {"plain", "psm", "spm"}


def test_no_documents(spark, no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0


def test_string_ids(spark):
    docs = spark.createDataFrame([("a-1", "some words here"), (None, "x")], "doc_id string, text string")
    got = sorted((tuple(r) for r in fim.fill_in_middle(docs).collect()), key=str)
    assert got == sorted((brute(i, t) for i, t in [("a-1", "some words here"), (None, "x")]), key=str)


@pytest.mark.parametrize("longest", [64, 4096])
def test_chunks_follow_content_and_combine(monkeypatch, longest):
    monkeypatch.setattr(fim, "LONGEST", longest)
    shared = prose(7, 900).encode()
    ends = []
    for head in (b"", b"another start of some length "):
        text = head + shared
        points = fim.cut_points(np.frombuffer(text, np.uint8)).tolist()
        cuts = list(fim.chunk_ends(points, 0, len(text)))
        assert cuts[-1] == len(text) and all(0 < b - a <= longest for a, b in zip([0, *cuts], cuts))
        ends.append({e - len(head) for e in cuts})
        made = fim.Cuts(text, cuts, fim.Summaries(2000))
        tokens = re.findall(rb"[A-Za-z]+|[^A-Za-z]", text)
        assert made.n == len(tokens)
        for k in range(0, len(tokens) + 1, 17):
            assert made.behind(k) == (len(b"".join(tokens[:k])),) * 2
    if longest == 4096:
        assert len(ends[0] & ends[1]) > 0.6 * len(ends[0])  # equal passages, equal chunks
