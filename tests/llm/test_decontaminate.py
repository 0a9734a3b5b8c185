import re

from strata.llm.decontaminate import decontaminate, drop_contaminated
from tests.llm.conftest import EDGE, make, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[a:a + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                found = wins.get(tuple(w[a:a + k]))
                if found:
                    hit.update(range(a, a + k))
                    ids |= found
        out.append((i, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


ITEM = prose(50, 25)
ITEMS = [(1, ITEM), (2, "one two three"), (3, "Solo"), (4, None), (5, ""), (6, "... !!"), (7, ITEM), (10, prose(51, 10)),
         (11, prose(52, 6)), (12, "the same the same the same the same the same the same")]
DOCS = EDGE + [
    (20, "before " + ITEM + " after"), (21, " ".join(ITEM.split()[5:15])), (22, " ".join(ITEM.split()[5:14])),
    (23, "ONE, two. Three! one two"), (24, "solo solo"), (25, prose(51, 10).upper()), (26, ITEM + " " + ITEM),
    (27, "the same the same the same the same the same the same the same"), (28, "été " + prose(52, 6) + "é"),
    (29, prose(52, 6)), (30, ("filler " * 5000) + ITEM), (31, "twoone two three"), (32, "one two\x00three"),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(make(spark, DOCS).repartition(5), items)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    assert rows(got) == brute(DOCS, ITEMS)


def test_shuffle_joins_give_the_same(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(decontaminate(make(spark, DOCS), items, broadcast_rows=0)) == brute(DOCS, ITEMS)


def test_same_id_different_texts(spark):
    docs = [(1, ITEM), (1, "clean text"), (None, ITEM), (None, "clean")]
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert rows(decontaminate(make(spark, docs), items)) == brute(docs, [(1, ITEM)])


def test_empty_sides(spark, no_docs, edge_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(no_docs, items).count() == 0
    assert rows(decontaminate(edge_docs, none)) == brute(EDGE, [])


def test_drop_contaminated(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make(spark, DOCS)
    out = drop_contaminated(docs, items)
    assert out.columns == docs.columns
    clean = {(i, t) for (i, t) in DOCS if not brute([(i, t)], ITEMS)[0][4]}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == clean


def test_no_python_in_the_plan(spark, edge_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate(edge_docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
