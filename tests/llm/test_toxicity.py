import random

from pyspark.sql import functions as F

from strata.llm.toxicity import (
    ToxicityModel,
    chance,
    draw,
    fit_toxicity,
    score_toxicity,
    toxic_parts,
    train_dictionaries,
    window_count,
    windows,
)
from tests.llm.conftest import EDGE, make

BAD = ["scoundrel", "nincompoop", "blockhead", "vermin", "lowlife"]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    names = ["".join(random.Random(k).choices("aeinorstlu", k=2 + k % 8)) for k in range(600)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = rng.choices(names, k=rng.randint(15, 200))
        if toxic:
            for _ in range(rng.randint(3, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def tables(spark, rows):
    return (make(spark, [(i, t) for i, t, _ in rows]),
            spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels, ~held)
    out = score_toxicity(docs, model).join(labels, "doc_id").where(held).collect()
    assert len(out) > 120
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_scores_do_not_depend_on_labels_of_held_out_rows(spark):
    rows = corpus(300)
    docs, labels = tables(spark, rows)
    learn = F.col("doc_id") % 5 != 0
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, score_toxicity(docs, fit_toxicity(docs.repartition(k), l, learn)).collect()))
                for k, l in ((1, labels), (6, flipped)))
    assert one == two


def test_edge_rows(spark, edge_docs, no_docs):
    docs, labels = tables(spark, corpus(300))
    model = fit_toxicity(docs, labels)
    out = score_toxicity(edge_docs, model)
    assert out.columns == ["doc_id", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[4] == by_id[5] and by_id[1] == by_id[2]
    assert score_toxicity(no_docs, model).count() == 0


def test_labels_missing_or_of_one_class(spark, edge_docs):
    schema = "doc_id long, quality int, toxic int"
    none = fit_toxicity(edge_docs, spark.createDataFrame([], schema))
    assert {r["score"] for r in score_toxicity(edge_docs, none).collect()} == {0.0}
    ones = fit_toxicity(edge_docs, spark.createDataFrame([(1, 0, 1), (2, 0, 1), (2, 0, 0), (3, 0, None), (None, 0, 1)], schema))
    assert {r["score"] for r in score_toxicity(edge_docs, ones).collect()} == {1.0}


def test_toxic_parts_are_what_the_other_class_lacks():
    toxic = [b"the cat scoundrel sat", b"a scoundrel ran", b"scoundrel of the"] * 20
    ordinary = [b"the cat sat", b"a dog ran of the house"] * 30
    assert set(toxic_parts(toxic, ordinary)) == {b" scoundrel"}


def test_windows_cover_the_text():
    for n in (0, 1, 64, 65, 96, 97, 1000):
        text = bytes(range(256)) * 4
        cut = windows(text[:n])
        assert len(cut) >= 1 and sum(len(w) for w in cut) >= n and (n == 0 or cut[-1][-1] == text[n - 1])


def test_model_without_weights_scores_the_prior():
    assert ToxicityModel(b" ", b" ", [], 0.25).scorer()("anything") == 0.25


def test_training_reads_whole_texts(spark):
    # every toxic passage lies behind 20,000 characters of ordinary text
    filler = " ".join(t for _, t, y in corpus(400, seed=5) if not y)[:21_000]
    rows = [(i, f"{filler[k:]}{filler[:k]} {t}", y) for i, t, y in corpus(250) for k in [i * 37 % 20_000]]
    docs, labels = tables(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = score_toxicity(docs, fit_toxicity(docs, labels, ~held)).join(labels, "doc_id").where(held).collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.95


def test_a_draw_of_windows_reaches_all_of_a_text():
    text = b" ".join(b"w%05d" % i for i in range(20_000))
    assert draw(text, 1, 1.0) == [text]
    words = [w for p in draw(text, 1, 0.1) for w in p.split()]
    assert set(words) <= set(text.split()) and 1_500 < len(set(words)) < 6_000
    assert min(words) < b"w00500" and max(words) > b"w19500"
    assert all(window_count(n) == len(windows(b"x" * n)) for n in range(300))


def test_rare_toxic_terms_reach_the_dictionary():
    # 40 terms, each in 2 % of 1,000 toxic texts, beside common ones
    rng = random.Random(7)
    rare = ["".join(random.Random(900 + k).choices("bcdfghjkmpqvwxyz", k=9)) for k in range(40)]
    rows = [t.encode() for _, t, y in corpus(5_000, seed=9) if not y][:4_000]
    ordinary, toxic = rows[1_000:], []
    for i, t in enumerate(rows[:1_000]):
        toxic.append(b" ".join([t, rng.choice(BAD).encode(), *(r.encode() for k, r in enumerate(rare) if (i + k) % 50 == 0)]))
    assert all(any(r.encode() in p for p in toxic_parts(toxic, ordinary)) for r in rare)
    _, extra = train_dictionaries([[t] for t in toxic], [[t] for t in ordinary])
    assert all(w.encode() in extra for w in [*rare, *BAD])


def test_chance_is_a_binomial_tail():
    assert abs(chance(3, 1, 0.5) - 5 / 16) < 1e-12 and abs(chance(10, 0, 0.2) - 0.2 ** 10) < 1e-18
