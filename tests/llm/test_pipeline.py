import os

import pytest

import corpus_pipeline
from strata.llm.common import table
from strata.llm.pieces import MODEL
from tests.llm.conftest import EDGE, make
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_near_dup import brute as components

SF = os.environ.get("STRATA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(MODEL)), reason="no driver tables here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "exact_dedup", "near_dedup", "decontaminate", "tokenize"]
    kept = steps["quality"](spark, docs, SF)
    assert kept.columns == COLUMNS
    rows = pairs(kept)
    assert set(rows) <= set(pairs(docs))
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert good & {i for i, _ in pairs(docs)} <= {i for i, _ in rows}  # clean documents stay

    exact = steps["exact_dedup"](spark, kept, SF)
    first = {}
    for i, t in rows:
        first[t] = min(first.get(t, i), i)
    rows = sorted((i, t) for t, i in first.items())
    assert exact.columns == COLUMNS and sorted(pairs(exact)) == rows

    near = steps["near_dedup"](spark, exact, SF)
    component = {i: c for i, _, c in components(rows)}
    rows = [(i, t) for i, t in rows if component[i] == i]
    assert near.columns == COLUMNS and sorted(pairs(near)) == rows

    clean = steps["decontaminate"](spark, near, SF)
    bad = {i for i, *_, c in hits(rows, items) if c}
    rows = [(i, t) for i, t in rows if i not in bad]
    assert bad and clean.columns == COLUMNS and sorted(pairs(clean)) == rows

    final = steps["tokenize"](spark, clean, SF)
    assert final.columns == [*COLUMNS, "n_tokens", "ids"]
    out = final.collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == rows
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)


def test_run_gives_the_last_stage(spark):
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == [*COLUMNS, "n_tokens", "ids"] and ran.count() > 100


def test_stages_take_odd_rows(spark, no_docs):
    docs = make(spark, EDGE)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0
        assert stage(spark, no_docs, SF).count() == 0


def test_tokenize_wins_over_input_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "some words", "old", 5, "en")], "doc_id long, text string, ids string, N_Tokens int, lang string")
    out = corpus_pipeline.tokenize(spark, docs, SF)
    assert out.columns == ["doc_id", "text", "lang", "n_tokens", "ids"]
    row = out.first()
    assert row["text"] == "some words" and row["n_tokens"] == len(row["ids"]) > 0
