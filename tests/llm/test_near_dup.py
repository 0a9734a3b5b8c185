import random

import pytest

from strata.llm import near_dup
from strata.llm.near_dup import contract, keep_one, near_duplicates, shingle_sets
from tests.llm.conftest import BASE, EDGE, make, prose


def sets_of(text):
    w = (text or "").encode().lower().split()
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows, percent=75):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    real = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for x, a in enumerate(real):
        for b in real[x + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    least = {}
    for k in real:
        least[find(k)] = min(least.get(find(k), 1 << 62), rows[k][0])
    return sorted([(i, len(sets[k]), least.get(find(k), i) if i is not None and sets[k] else i)
                   for k, (i, _) in enumerate(rows)], key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def variants(seed, n, words, changes):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = "v" + str(rng.randrange(10 ** 6))
        out.append(" ".join(w))
    return out


def test_edge_rows_match_brute_force(spark):
    assert got(near_duplicates(make(spark, EDGE).repartition(4))) == brute(EDGE)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_groups_match_brute_force(spark, rounds):
    texts = variants(1, 60, 80, 6) + variants(2, 40, 200, 14) + variants(3, 30, 30, 2) + [prose(k, 90) for k in range(100, 140)]
    passage = prose(77, 40)
    texts += [passage + " " + prose(k, 12 + k % 30) for k in range(200, 260)]
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts))
    assert got(near_duplicates(make(spark, rows).repartition(6), star_rounds=rounds, run_bytes=4000)) == brute(rows)


def test_chain_of_links_is_one_component(spark):
    w = prose(9, 400).split()
    rows = [(100 - k, " ".join(w[4 * k:4 * k + 60])) for k in range(80)]
    want = brute(rows)
    assert len({c for _, _, c in want}) < 10
    assert got(near_duplicates(make(spark, rows), run_bytes=3000)) == want


def test_threshold_is_exact(spark):
    rows = []
    for k, n in enumerate(range(20, 60)):  # one changed word removes five shingles of n
        w = [f"{k}w{i}" for i in range(n + 4)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:10], "changed", *w[11:]]))]
    want = brute(rows)
    assert 0 < sum(i != c for i, _, c in want) < 40
    assert got(near_duplicates(make(spark, rows))) == want


def test_empty_and_tiny(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert got(near_duplicates(make(spark, [(1, "a")]))) == [(1, 1, 1)]


def test_keep_one(spark):
    rows = [r for r in EDGE if r != (3, BASE)]
    out = keep_one(make(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        [(i, t) for (i, t) in rows if dict((a, c) for a, _, c in brute(rows))[i] == i], key=str)
    assert "component_id" not in out.columns and len(out.columns) == 13


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, u, v = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, a), (3, a + " z"), (3, u), (3, v), (4, v + " y"), (0, u + " x"), (3, u), (None, a), (None, u)]
    assert got(near_duplicates(make(spark, rows).repartition(3))) == brute(rows)
    left = sorted(((r["doc_id"], r["text"]) for r in keep_one(make(spark, rows)).collect()), key=str)
    # of (3, v) and (4, v y) the first stays; (3, a z) and both (3, u) have a smaller one
    assert left == sorted([(1, a), (3, v), (0, u + " x"), (None, a), (None, u)], key=str)


def test_keep_one_takes_string_ids(spark):
    a, u = prose(31, 60), prose(32, 60)
    docs = spark.createDataFrame([("b", a), ("a9", a + " z"), ("c", u), (None, u)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "-") for r in keep_one(docs).collect()) == ["-", "a9", "c"]


def test_contract_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    labels = spark.createDataFrame([(i, i) for i in range(200)], "node long, comp long")
    out = dict(map(tuple, contract(spark.createDataFrame(edges, "a long, b long"), labels)[0].collect()))
    parent = list(range(200))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for i in range(200):
        groups.setdefault(find(i), set()).add(out[i])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_shingles_ignore_case_and_kind_of_white_space():
    a, b, c = shingle_sets(["A b\tc\nd  E f", "a B c d e F", "a b c d e"])
    assert a.tolist() == b.tolist() and len(a) == 2 and c[0] in a


def test_bad_percent(edge_docs):
    with pytest.raises(ValueError):
        near_duplicates(edge_docs, percent=40)


def test_rounds_build_no_broadcasts_in_the_driver(spark, monkeypatch):
    """Small tables are joined in every round; a broadcast of each would fill the driver."""
    plans = []

    def seen(df, name):
        if name in ("star-pairs", "moves", "labels"):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    kept = near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", seen)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[:40 + i % 3], f"own{i % 5}"])) for i in range(12)]
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert {n for n, _ in plans} == {"star-pairs", "moves", "labels"}
    assert [n for n, p in plans if "BroadcastExchange" in p] == []
