"""Near duplicates: an exact Jaccard join of shingle sets by T-occurrence search.

Two texts link when their sets of word shingles overlap by at least ``percent``
per cent of their union; then a text of n shingles shares at least
T = ceil(n * percent / 100) of them with every text it links to.

1. Texts with equal sets are one class from the start (a 192-bit key of the set),
   so exact copies never meet as pairs.
2. Every run of documents asks for its distinct shingles which other runs have
   them too (``runs``: a shingle in a third of all texts is one entry per run).
   A class of which fewer than T shingles occur elsewhere has no link and leaves.
3. For what is left, the inverted lists are ordered by length (ties by shingle).
   The T - 1 longest lists of a text are put aside (DivideSkip); any text it links
   to must occur in one of the short ones, so only these are merged, and only where
   length and position still allow the overlap.
4. Lists are merged in star rounds first: every text meets, of the leaders of its
   lists (a random member of the list's largest component, another one every
   round), the one it shares most short lists with.  Verified links merge
   components.  The last round meets all pairs whose components still differ, each
   pair once (in its first shared list), and keeps those that share enough short
   lists to reach the overlap if all the long ones agreed.  So large groups cost a few rows per text,
   and no link between different components is lost.
5. Candidates are verified by binary probes of one text's shingles in the other's
   sorted array.

Components are contracted in about log(n) small joins; they stay DataFrames
throughout.  A task holds one run (about 6 MB of text), one
bucket, or a pair of texts.

Defined results: null and empty texts have no shingles and link with nothing; a
text of fewer words than a shingle is one shingle; rows with a null id get their
count and no component and lend no links; rows that repeat an id are compared by
their own texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import give_back, lean, materialize, slices, small_batches
from strata.llm.ranks import positions
from strata.llm.runs import (RUN_BYTES, cut, mix, pack, pack_sorted, release_shuffles, run_of, shared_sizes, unpack,
                             unpack_sorted, word_hashes)

WORDS, PERCENT, STAR_ROUNDS = 5, 75, 6
#: keys are cut to 48 bits for the question whether they occur elsewhere; that is only a filter
_FILTER = np.uint64(0xFFFFFFFFFFFF0000)
_SEVERAL = 0xFFFFFFFF


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    hashes, ends = word_hashes(texts)
    n = len(hashes) - words + 1
    rolled = np.zeros(0, np.uint64)
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for j in range(words):
            rolled += hashes[j:j + n] * mix(np.array([j + 1], np.uint64))[0]
        rolled = mix(rolled)
    out, begin = [], 0
    for end in ends.tolist():
        count = end - begin
        if count >= words:
            out.append(np.unique(rolled[begin:end - words + 1]))
        elif count:
            factors = mix(np.arange(1, count + 1, dtype=np.uint64))
            out.append(mix(np.array([(hashes[begin:end] * factors).sum() + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def _set_key(keys: np.ndarray) -> tuple[int, int, int]:
    second = mix(keys ^ np.uint64(0xA0761D6478BD642F))
    return (len(keys), int(keys.sum(dtype=np.uint64).view(np.int64)) if len(keys) else 0,
            int(second.sum(dtype=np.uint64).view(np.int64)) if len(keys) else 0)


def least_overlap(n: int | np.ndarray, percent: int):
    """T: shingles a text of ``n`` shares with every text it links to."""
    return -(-n * percent // 100)


_PASS = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()),
                   ("place", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()),
                   ("s2", pa.int64()), ("local", pa.int64())])
_PASS_DDL = ("bucket int, run long, keys binary, docs binary, place int, id long, n long, s1 long, s2 long, "
             "local long")


def _rows(schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
        schema=schema)


def _one_run(run: int, ids: list, sets: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The run's question (one slice per bucket) and one row per document."""
    set_keys = [_set_key(s) for s in sets]
    first: dict = {}
    for i, k in enumerate(set_keys):
        if k[0] and ids[i] is not None:
            first.setdefault(k, i)
    asking = sorted(first.values())
    every = np.concatenate([sets[i] for i in asking]) & _FILTER if asking else np.zeros(0, np.uint64)
    owner = np.repeat(np.array(asking, np.int64), [len(sets[i]) for i in asking])
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(every)))
    several = np.repeat(size > 1, size)
    local = np.bincount(owner[several], minlength=len(ids))
    keys = every[at]
    docs = np.where(size > 1, _SEVERAL, owner[at]).astype(np.uint32)
    ends = cut(keys, buckets)
    cuts = [(b, s, e) for b, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
    yield _rows(_PASS, len(cuts), bucket=[b for b, _, _ in cuts], run=[run] * len(cuts),
                keys=[pack_sorted(keys[s:e]) for _, s, e in cuts], docs=[pack(docs[s:e]) for _, s, e in cuts])
    # documents travel in buckets of their own
    yield _rows(_PASS, len(ids), bucket=[-1 - run % buckets] * len(ids), run=[run] * len(ids),
                place=list(range(len(ids))), id=ids, n=[k[0] for k in set_keys], s1=[k[1] for k in set_keys],
                s2=[k[2] for k in set_keys], local=local.tolist())


def _ask(words: int, buckets: int, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1, run_bytes):
                ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                yield from _one_run((part << 32) + number, ids, shingle_sets(texts, words), buckets)
                number += 1
        give_back()
    return run


@lean
def _shared(asked: pa.Table) -> pa.Table:
    """Per run, how many of each document's own keys in this bucket other runs have too."""
    if asked["bucket"][0].as_py() < 0:
        return asked
    keys = [unpack_sorted(k) for k in asked["keys"].to_pylist()]
    size = [len(k) for k in keys]
    docs = np.concatenate([unpack(d, np.uint32) for d in asked["docs"].to_pylist()])
    every = np.concatenate(keys)
    by = np.argsort(every, kind="stable")
    k = every[by]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    times = np.diff(np.append(at, len(k)))
    elsewhere = np.empty(len(k), bool)
    elsewhere[by] = np.repeat(times > 1, times)
    elsewhere &= docs != _SEVERAL
    ends = np.cumsum([0, *size])
    counts = [pack(np.bincount(docs[s:e][elsewhere[s:e]]).astype(np.int64)) if elsewhere[s:e].any() else None
              for s, e in zip(ends, ends[1:])]
    return pa.Table.from_batches([_rows(_PASS, len(size), bucket=asked["bucket"].to_pylist(),
                                        run=asked["run"].to_pylist(), docs=counts)], schema=_PASS)


_DOC = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                  ("shared", pa.int64())])


@lean
def _documents(table: pa.Table) -> pa.Table:
    """Rows of a run's documents with the sum of its buckets' counts."""
    is_doc = pc.is_valid(table["place"])
    docs = table.filter(is_doc).sort_by("place")
    total = np.array(docs["local"].to_pylist(), np.int64)
    for data in table.filter(pc.invert(is_doc))["docs"].to_pylist():
        if data is not None:
            counts = unpack(data, np.int64)
            total[:len(counts)] += counts
    return pa.Table.from_arrays([*(docs[c].combine_chunks() for c in ("id", "n", "s1", "s2")), pa.array(total)],
                                schema=_DOC)


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join.  Rounds join small tables dozens of times; as broadcasts
    each of them is built in the driver's heap, in pages of up to 64 MB, whatever the rows need."""
    return df.hint("merge")


# -- components -------------------------------------------------------------------------------

def contract(edges: DataFrame, labels: DataFrame, steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels (node, comp) after merging components that ``edges`` (a, b: components) join, and
    the edges between components that are left (none unless ``steps`` stops it early).

    Every component moves to the best of its neighbours and itself: the largest, then
    the one with most edges, then by a random priority.  Stars so take one step, and
    any graph about log(n) steps.
    """
    turn = 0
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while (steps is None or turn < steps) and not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        size = labels.groupBy(F.col("comp").alias("a")).agg(F.count(F.lit(1)).alias("size"))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
        rank = degree.join(sorted_side(size), "a").select(F.col("a").alias("b"), F.struct(
            -F.col("size"), -F.col("degree"), F.xxhash64("a", F.lit(turn)), "a").alias("rank"))
        near = both.unionByName(degree.select("a", F.col("a").alias("b")))
        moved = materialize(near.join(sorted_side(rank), "b").groupBy("a").agg(F.min_by("b", "rank").alias("to")), "moves")
        labels = materialize(labels.join(sorted_side(moved), labels["comp"] == moved["a"], "left")
                             .select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        to_a = moved.select("a", F.col("to").alias("na"))
        to_b = moved.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        edges = materialize(edges.join(sorted_side(to_a), "a").join(sorted_side(to_b), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
                            .where("a <> b").distinct(), "edges")
    return labels, edges


# -- candidates -------------------------------------------------------------------------------

def _possible(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and position bounds: the overlap from this shared shingle on can still be enough."""
    need = F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - p1, n2 - p2) >= need)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets overlap enough."""
    left = sets.select(F.col("rep").alias("x"), F.col("keys").alias("xs"))
    right = sets.select(F.col("rep").alias("y"), F.col("keys").alias("ys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 2, 4 << 20) for b in batches):
            keep = []
            for xs, ys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(xs, np.uint64), np.frombuffer(ys, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(same * 100 >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["x", "y"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return (pairs.join(left, "x").join(right, "y").select("x", "y", "xs", "ys")
            .mapInArrow(run, "x long, y long"))


def _short_lists(sets: DataFrame, percent: int, run_bytes: int) -> DataFrame:
    """Postings (key, rep, n, pos) of the short lists of every class, lists of one left out."""
    runs = shared_sizes(sets, "keys", run_bytes)
    dealt = sets.withColumn("run", run_of("rep", runs))
    ask = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())])
    tell = pa.schema([("run", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])

    @lean
    def question(table: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()])
        keys, times = np.unique(every, return_counts=True)
        ends = cut(keys, runs)
        cuts = [(b, s, e) for b, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
        return pa.Table.from_batches([_rows(
            ask, len(cuts), bucket=[b for b, _, _ in cuts], run=[table["run"][0].as_py()] * len(cuts),
            keys=[pack_sorted(keys[s:e]) for _, s, e in cuts], data=[pack(times[s:e]) for _, s, e in cuts])], schema=ask)

    @lean
    def lengths(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
        ends = np.cumsum([0] + [len(k) for k in keys])
        distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, places, np.concatenate([unpack(d, np.int64) for d in table["data"].to_pylist()]))
        return pa.Table.from_batches([_rows(
            tell, len(keys), run=table["run"].to_pylist(), bucket=table["bucket"].to_pylist(),
            data=[pack(total[places[s:e]]) for s, e in zip(ends, ends[1:])])], schema=tell)

    @lean
    def postings(table: pa.Table, info: pa.Table) -> pa.Table:
        sets_ = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        keys = np.unique(np.concatenate(sets_)) if sets_ else np.zeros(0, np.uint64)
        ends, times = cut(keys, runs), np.zeros(len(keys), np.int64)
        for b, data in zip(info["bucket"].to_pylist(), info["data"].to_pylist()):
            times[ends[b]:ends[b + 1]] = unpack(data, np.int64)
        out = [[], [], [], []]
        for rep, own in zip(table["rep"].to_pylist(), sets_):
            of = times[np.searchsorted(keys, own)]
            order = np.lexsort((own, of))[:len(own) - int(least_overlap(len(own), percent)) + 1]
            at = np.flatnonzero(of[order] > 1)
            out[0].append(own[order[at]].view(np.int64))
            out[1].append(np.full(len(at), rep))
            out[2].append(np.full(len(at), len(own)))
            out[3].append(at)
        return pa.table({name: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
                         for name, c in zip(("key", "rep", "n", "pos"), out)})

    told = materialize(dealt.groupBy("run").applyInArrow(question, "bucket int, run int, keys binary, data binary")
                       .groupBy("bucket").applyInArrow(lengths, "run int, bucket int, data binary"), "list-lengths")
    return dealt.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(
        postings, "key long, rep long, n long, pos long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = shared_sizes(narrow, "text", run_bytes)
    rows = materialize(
        narrow.mapInArrow(_ask(words, buckets, run_bytes), _PASS_DDL)
        .groupBy("bucket").applyInArrow(_shared, _PASS_DDL)
        .groupBy("run").applyInArrow(_documents, "id long, n long, s1 long, s2 long, shared long"), "shingle-counts")
    release_shuffles(spark)
    known = rows.where("n > 0 AND id IS NOT NULL")
    # a class has a number of its own: two texts of one id are two classes
    classes = materialize(known.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.max("shared").alias("shared"))
                          .withColumn("rep", F.monotonically_increasing_id()), "classes")
    left = classes.where(F.col("shared") >= F.ceil(F.col("n") * percent / 100 - 1e-9)).drop("shared")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 4, 4 << 20) for b in batches):
            sets = shingle_sets(batch.column(4).to_pylist(), words)
            want = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))
            keep = [i for i, (s, w) in enumerate(zip(sets, want)) if _set_key(s) == w]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())),
                 pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["rep", "keys"])
        give_back()

    sets = materialize(narrow.where("id IS NOT NULL").join(left, "id")
                       .select("rep", "n", "s1", "s2", "text").mapInArrow(sets_of, "rep long, keys binary")
                       .dropDuplicates(["rep", "keys"]), "sets")
    release_shuffles(spark)
    lists = materialize(_short_lists(sets, percent, run_bytes), "short-lists")
    release_shuffles(spark)
    labels = materialize(lists.select(F.col("rep").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")

    tested = left = None
    for turn in range(star_rounds):
        size = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        placed = (lists.join(sorted_side(labels), lists["rep"] == labels["node"]).join(sorted_side(size), "comp")
                  .select("key", "rep", "n", "pos", "comp", "size"))
        leaders = placed.groupBy("key").agg(F.min_by(
            F.struct("rep", "n", "pos", "comp"), F.struct(-F.col("size"), F.xxhash64("rep", F.lit(turn)), "rep")).alias("l"))
        met = (placed.join(sorted_side(leaders), "key")
               .where((F.col("comp") != F.col("l.comp"))
                      & _possible(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos"), percent))
               .groupBy(F.col("rep").alias("x"), F.col("l.rep").alias("y")).agg(F.count(F.lit(1)).alias("times")))
        if tested is not None:
            met = met.join(sorted_side(tested), ["x", "y"], "left_anti")
        best = materialize(met.groupBy("x").agg(F.max_by("y", F.struct("times", "y")).alias("y")), "star-pairs")
        if best.isEmpty():  # rounds only spare the last one work
            break
        tested = best if tested is None else tested.unionByName(best)
        labels, left = _merge(_verify(best, sets, percent), labels, left, 1)
    if left is not None:
        labels, left = contract(left, labels)
    placed = materialize(lists.join(labels, lists["rep"] == labels["node"]).select("key", "rep", "n", "pos", "comp"),
                         "placed")
    # only lists that still hold several components; each class with its shingles in those, rarest first
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_ = materialize(placed.join(mixed, "key"), "open-lists")
    own = open_.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("own")).select(
        "rep", F.col("own.key").alias("own"))
    open_ = open_.join(own, "rep")
    a, b = open_.alias("a"), open_.alias("b")
    nx, ny = F.col("a.n"), F.col("b.n")
    need = F.ceil((nx + ny) * percent / (100 + percent) - 1e-9)
    aside = F.ceil(F.greatest(nx, ny) * percent / 100 - 1e-9) - 1  # lists that are probed, not merged
    both = F.array_intersect(F.col("a.own"), F.col("b.own"))  # in list order
    pairs = (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep"))
                    & (F.col("a.comp") != F.col("b.comp"))
                    & _possible(nx, F.col("a.pos"), ny, F.col("b.pos"), percent)
                    # a pair comes out once, from its first shared list
                    & (F.element_at(both, 1) == F.col("a.key")) & (F.size(both) + aside >= need))
             .select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")))
    if tested is not None:
        either = tested.unionByName(tested.select(F.col("y").alias("x"), F.col("x").alias("y")))
        pairs = pairs.join(sorted_side(either), ["x", "y"], "left_anti")
    labels, _ = _merge(_verify(pairs, sets, percent), labels, left, None)

    smallest = (labels.join(classes.select(F.col("rep").alias("node"), "id"), "node")
                .groupBy("comp").agg(F.min("id").alias("component")))
    of_rep = labels.join(smallest, "comp").select(F.col("node").alias("rep"), "component")
    of_class = classes.join(of_rep, "rep", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("c"))
    return (rows.join(of_class, ["n", "s1", "s2"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document (the smallest id) of each component, all columns kept; rows without an id stay.

    A document is an id with a text.  Ids that are repeated, or are no integers, are replaced by
    the document's place in the order of (id, text digest), so each text is kept or dropped by its own links.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    number = F.col("_id")
    integers = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    if not integers or rows.where("_id IS NOT NULL").groupBy("_id").count().where("count > 1").take(1):
        rows = rows.withColumn("_sha", F.sha2("_text", 256))
        known = materialize(rows.where("_id IS NOT NULL").select(F.col("_id").alias("_of"), F.col("_sha").alias("_as"))
                            .distinct(), "documents")
        placed = positions(known, [], ["_of", "_as"]).drop("size")
        rows = materialize(rows.join(placed, (F.col("_id") == F.col("_of")) & (F.col("_sha") == F.col("_as")), "left")
                           .drop("_of", "_as", "_sha"), "numbered")
        number = F.col("pos")
    rows = rows.select("_row", number.alias("_num"), "_text")
    found = near_duplicates(rows, "_num", "_text", **options)
    drop = materialize(found.where("_num != component_id").select(F.col("_num").alias("_drop")).distinct(), "near-copies")
    kept = rows.join(drop, F.col("_num") == F.col("_drop"), "left_anti")
    return kept.select("_row.*")


def _merge(links: DataFrame, labels: DataFrame, left: DataFrame | None, steps: int | None):
    """``contract`` over the components of new links and the edges ``left`` over from before."""
    x = labels.select(F.col("node").alias("x"), F.col("comp").alias("a"))
    y = labels.select(F.col("node").alias("y"), F.col("comp").alias("b"))
    edges = links.join(sorted_side(x), "x").join(sorted_side(y), "y").select("a", "b")
    return contract(edges if left is None else edges.unionByName(left), labels, steps)
