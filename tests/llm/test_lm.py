import math
from collections import Counter

from pyspark.sql import functions as F

from strata.llm.lm import em_weights, score_lm
from tests.llm.conftest import EDGE, make, prose


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows, learn, delete, runs=None):
    kept, cut = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        if learn(i):
            w = tokens(t)
            for c, x in zip(cut if delete(i) else kept, (w, zip([None, *w[:-1]], w))):
                c.update(x)
    n, v = sum(kept[0].values()), len(kept[0])
    bucket = lambda c: int(math.floor(math.log2(c)) + 1) if c else 0
    cells = Counter()
    for i, t in rows:
        if learn(i) and delete(i):
            w = tokens(t)
            for u, x in zip([None, *w[:-1]], w):
                c = kept[0][u]
                step = [-1 if not p else round(-math.log10(p) * 16)
                        for p in (kept[1][(u, x)] / c if c else 0, kept[0][x] / max(n, 1))]
                cells[(bucket(c), *step)] += 1
    weights = em_weights([(*k, m) for k, m in cells.items()], 1 / (v + 1))
    one, two = kept[0] + cut[0], kept[1] + cut[1]
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in rows:
        w, score, base = tokens(t), 0.0, 0.0
        for u, x in zip([None, *w[:-1]], w):
            a, b, c = weights[bucket(one[u])]
            score += math.log10(a * (two[(u, x)] / one[u] if one[u] else 0) + b * one[x] / max(n, 1) + c / (v + 1))
            base += math.log10((one[x] + 1) / (n + v + 1))
        out.setdefault((i, len(w)), []).append((sum(one[x] > 0 for x in w), n, base, score))
    return out


def check(df, want):
    rows = df.collect()
    assert len(rows) == sum(map(len, want.values()))
    for r in rows:
        assert any((r["n_known"], r["train_tokens"]) == (k, n) and math.isclose(r["base_score"], b, rel_tol=1e-9)
                   and math.isclose(r["score"], s, rel_tol=1e-9) for k, n, b, s in want[(r[0], r["n_tokens"])]), r


ROWS = EDGE + [(100 + k, prose(k, 30 + k % 50, 150)) for k in range(120)]


def test_scores_match_brute_force(spark):
    learn, delete = F.col("doc_id") % 7 != 2, F.col("doc_id") % 7 == 3
    out = score_lm(make(spark, ROWS).repartition(5), learn, delete, run_bytes=20_000)
    assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check(out, brute(ROWS, lambda i: i is not None and i % 7 != 2, lambda i: i % 7 == 3))


def test_nothing_to_learn_from_and_nothing_deleted(spark):
    check(score_lm(make(spark, EDGE), F.lit(False)), brute(EDGE, lambda i: False, lambda i: False))
    check(score_lm(make(spark, EDGE), F.lit(True), F.lit(False)), brute(EDGE, lambda i: True, lambda i: False))


def test_empty_table(no_docs):
    assert score_lm(no_docs).count() == 0


def test_em_recovers_the_better_estimate():
    w = em_weights([(3, 2, 40, 1000)], 1e-6)
    assert w[3][0] > 0.95  # the pair is 10^(38/16) times likelier under the bigram
    w = em_weights([(3, -1, 20, 1000), (0, -1, 20, 10)], 1e-6)
    assert w[3][1] > 0.95 and w[0][0] == 0 and abs(w.sum(axis=1) - 1).max() < 1e-9


def test_model_beats_the_base_on_unseen_text(spark):
    rows = []
    for k in range(300):  # each word is followed by one of two
        w, x = [], k
        for _ in range(40):
            x = (x * 2 + (hash((k, len(w))) & 1)) % 97
            w.append(f"w{x}")
        rows.append((k, " ".join(w)))
    out = score_lm(make(spark, rows), F.col("doc_id") % 4 != 0, F.col("doc_id") % 4 == 1)
    r = out.where("doc_id % 4 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.6 * r[1]
