import random

from strata.llm.quality import GOOD, JUNK, em_posteriors, filter_quality, fit_quality, score_quality, votes
from tests.llm.conftest import EDGE, make


def sentence(rng, n=12):
    words = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 9))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def corpus(n=600, seed=3):
    """(text, good) with five kinds of junk, some behind a clean first line."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        good = rng.random() < 0.8
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 25)))
        if not good:
            w = text.split()
            kind = rng.randrange(5)
            text = (" ".join(x for x in w for _ in range(12)) if kind == 0 else " ".join(x.upper() + "!!" for x in w)
                    if kind == 1 else " ".join(x + rng.choice(["***", "%%%", "&&&", "$$$"]) for x in w) if kind == 2 else
                    " | ".join(w) if kind == 3 else " ".join(w[:3] * 40))
            if rng.random() < 0.3:
                text = sentence(rng) + "\n" + text
        out.append((text, good))
    return out


def test_votes_name_the_kind_of_junk():
    assert votes(b"") == "2" * 8 and votes(b"Short one.")[1:] == "2" * 7
    assert votes(("word " * 60).encode())[2] == str(JUNK)
    assert votes(b"ABC DEF GHI JKL MNO PQR!")[1] == str(JUNK)
    good = " ".join(sentence(random.Random(k)) for k in range(9))
    assert set(votes(good.encode())) <= {str(GOOD), "2"}


def test_em_trusts_a_labeller_alone():
    counts = {"11111111": 900, "01111111": 60, "11011101": 40, "22222222": 30}
    p = em_posteriors(counts)
    assert p["11111111"] > 0.99 and p["01111111"] < 0.05 and p["11011101"] < 0.05 and p["22222222"] > 0.8
    assert em_posteriors({}) == {}


def test_held_out_accuracy(spark):
    train, test = corpus(), corpus(400, 9)
    model = fit_quality(make(spark, [(i, t) for i, (t, _) in enumerate(train)]))
    out = {r["doc_id"]: r for r in score_quality(make(spark, [(i, t) for i, (t, _) in enumerate(test)]), model).collect()}
    good = [out[i]["keep"] for i, (_, g) in enumerate(test) if g]
    junk = [out[i]["keep"] for i, (_, g) in enumerate(test) if not g]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.15


def test_filter_agrees_with_scores_and_keeps_columns(spark):
    docs = make(spark, [(i, t) for i, (t, _) in enumerate(corpus(200))] + EDGE)
    model = fit_quality(docs)
    kept = filter_quality(docs, model)
    assert kept.columns == docs.columns
    keep = score_quality(docs, model)
    assert keep.columns == ["doc_id", "score", "keep"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(
        (r["doc_id"] for r in keep.where("keep").collect()), key=str)
    scores = {r["doc_id"]: r["score"] for r in keep.collect()}
    assert scores[4] == scores[5] and all(0 <= s <= 1 for s in scores.values())


def test_empty_table_and_one_class(spark, no_docs):
    model = fit_quality(no_docs)
    assert score_quality(no_docs, model).count() == 0 and filter_quality(no_docs, model).count() == 0
    clean = make(spark, [(i, t) for i, (t, g) in enumerate(corpus(150)) if g])
    assert score_quality(clean, fit_quality(clean)).where("NOT keep").count() <= 2
