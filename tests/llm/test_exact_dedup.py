import hashlib
from collections import defaultdict

import pytest

from strata.llm.exact_dedup import drop_exact_copies, exact_dedup
from tests.llm.conftest import EDGE, make


def brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_groups_match_brute_force(spark, keep, pick, fan_in):
    docs = make(spark, EDGE).repartition(7)
    got = exact_dedup(docs, keep=keep, fan_in=fan_in)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(EDGE, pick)


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_one_hot_group_over_many_partitions(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup(make(spark, rows).repartition(40), keep="largest", fan_in=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, max)


def test_drop_keeps_columns_and_one_row_per_text(edge_docs):
    out = drop_exact_copies(edge_docs)
    assert out.columns == edge_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(t or "" for _, t in rows) == sorted({t or "" for _, t in EDGE})
    assert (1, EDGE[0][1]) in rows


def test_no_python_in_the_plan(edge_docs):
    plan = exact_dedup(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_bad_arguments(edge_docs):
    with pytest.raises(ValueError):
        exact_dedup(edge_docs, keep="first")
    with pytest.raises(ValueError):
        exact_dedup(edge_docs, fan_in=1)
