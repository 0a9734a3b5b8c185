import hashlib

import pytest
from pyspark.sql import functions as F

from strata.llm.merkle import merkle_manifest, proof_digest
from strata.llm.ranks import positions
from tests.llm.conftest import EDGE, make, prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes, arity):
    """The top of a tree over ``nodes``, and for each node its siblings as (left, right) by level."""
    paths, at, row = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(row) > 1:
        for k, i in enumerate(at):
            a = i // arity * arity
            paths[k].append(("".join(row[a:i]), "".join(row[i + 1:a + arity])))
        row = [sha("".join(row[i:i + arity])) for i in range(0, len(row), arity)]
        at = [i // arity for i in at]
    return row[0], paths


def brute(rows, arity=2, tamper=lambda i: False):
    groups = {}
    for i, lang, n, text in rows:
        key = (lang is not None, (lang or "").encode())
        groups.setdefault(key, []).append((i is not None, i, leaf(i, "s", lang, n, text), lang, n, text))
    keys, out = sorted(groups), []
    for k in keys:
        groups[k].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    tops = [climb([r[2] for r in groups[k]], arity) for k in keys]
    root, high = climb([t for t, _ in tops], arity)
    for k, (sub, paths), end in zip(keys, tops, high):
        for (_, i, d, lang, n, text), path in zip(groups[k], paths):
            seen = leaf(i, "s", lang, n + 1, text) if tamper(i) and n is not None else d
            for left, right in path + end:
                seen = sha(left + seen + right)
            proof = sha("".join(a + b for a, b in path + end))
            out.append((i, d, sub, root, proof, seen, seen == root))
    return sorted(out, key=str)


def docs_of(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, node string, grp int, pos int, size int, id string, path int"
    return spark.createDataFrame([(i, "s", lang, n, t, "x", 1, 2, 3, "y", 4) for i, lang, n, t in rows], schema)


def got(docs, **how):
    out = merkle_manifest(docs, observed={"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1)
                                          .otherwise(F.col("n_chars"))}, **how)
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=str)


def third(i):
    return i is not None and i % 3 == 0


@pytest.mark.parametrize("arity,levels", [(2, 12), (2, 1), (2, 2), (3, 1), (3, 2), (5, 1)])
def test_groups_of_many_sizes_match_brute_force(spark, arity, levels):
    rows = [(1000 * g + 7 * j % 1000, lang, j, prose(j, j % 5)) for g, (lang, n) in
            enumerate([("en", 67), ("de", 16), ("fr", 9), (None, 5), ("", 1), ("é", 2), ("zz", 1)]) for j in range(n)]
    found = got(docs_of(spark, rows).repartition(5), arity=arity, levels=levels)
    assert found == brute(rows, arity, third)
    assert {r[-1] for r in found} == {True, False}


def test_odd_rows_match_brute_force(spark):
    rows = [(i, "en", None if t is None else len(t), t) for i, t in EDGE] + [(3, None, 4, None), (None, None, None, None)] * 2
    rows += [(2 ** 53 + 1, "en", 1, "big"), (2 ** 53 + 2, "en", 1, "big"), (-5, "de", 0, "")]
    assert got(docs_of(spark, rows)) == brute(rows, tamper=third)


def test_without_observed_fields_all_rows_verify(spark):
    rows = [(j, f"l{j % 40:02}", j, "t") for j in range(100)]
    out = merkle_manifest(docs_of(spark, rows), levels=2).collect()
    assert len(out) == 100 and all(r["verified"] for r in out)


def test_no_rows_one_row_and_string_ids(spark, no_docs):
    assert merkle_manifest(no_docs).count() == 0
    one = merkle_manifest(make(spark, [(4, "only")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == ""
    docs = docs_of(spark, [(j, "en", j, "t") for j in range(6)]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    out = merkle_manifest(docs)
    assert out.schema["doc_id"].dataType.simpleString() == "string" and out.where("verified").count() == 6


def test_positions_of_a_hot_group_are_dense(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
                                  (F.col("id") % 50).alias("o"))
    out = positions(df, ["g"], ["o"]).collect()
    by = {}
    for r in out:
        by.setdefault(r["g"], []).append((r["pos"], r["o"], r["size"]))
    for found in by.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [o for _, o, _ in found] == sorted(o for _, o, _ in found) and {s for *_, s in found} == {len(found)}
