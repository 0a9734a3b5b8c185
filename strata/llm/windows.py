"""Substring deduplication: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A word is removed when a window of ``window`` consecutive words covers it whose word
sequence also starts earlier: in a document with a smaller id, or before it in the same
document.  All windows are judged on the input.

Documents are dealt to *runs* of a few MB (``runs``); a run hashes every window by
prefix sums of a polynomial over its words' hashes, so a window costs a subtraction and
a product.  Three jobs read the runs:

1. Count: every run sends its distinct window hashes, 48 bits of them, sorted and
   delta-coded, in slices by key range; a slice's task counts in how many runs a hash
   occurs and answers one bit per hash.  This only narrows the search.
2. Least owner: of hashes that several runs have, each run sends all 96 bits with the
   smallest id that has the window, and learns whether another run has a smaller one.
3. Removal: the repeated windows of each document merge into maximal intervals of
   words, and the words outside them are kept.

A passage that a third of all documents share costs a task one entry per run, and rows
of one id are dealt by their texts too, so neither is hot.  A task holds one run (some
16 times its bytes) or one key range of the runs' hashes.

Windows are equal when both polynomials agree (96 bits): among n different windows a
false repeat has probability n^2 / 2^97, 0.002 for the 10^13 windows of 100 TB.

Defined results: null and empty texts have no words; texts of fewer words than the
window lose nothing; rows that share an id are documents of their own that do not
remove each other's words; null ids count as one id smaller than all others; ids may
be integers or strings (ordered by their bytes); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import lean, materialize
from strata.llm.ranks import positions
from strata.llm.runs import RUN_BYTES, cut, mix, pack, pack_sorted, release_shuffles, shared_sizes, unpack, unpack_sorted

WINDOW = 20
_LEAST = -(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20
#: a random-looking value per byte, and odd bases of the polynomials over bytes and (two) over words
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASES = (0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: bits of a hash that the count compares, and runs whose hashes one key range holds
_COUNTED = np.uint64(0xFFFFFFFFFFFF0000)
_RUNS_PER_BUCKET = 4
#: runs that a task works through, one after the other
_RUNS_PER_TASK = 8


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words ``begin:end`` of ``data``, block by block."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        a = int(begin[at])
        stop = max(int(np.searchsorted(end, a + _BLOCK, "right")), at + 1)  # at least one word
        z = int(end[stop - 1])
        power, inverse = _tables(z - a)
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:z]] * power[:z - a], dtype=np.uint64, out=sums[1:])
        b, e = begin[at:stop] - a, end[at:stop] - a
        out[at:stop] = (sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64)
        at = stop
    return mix(out)


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the byte base and of its inverse, at least ``n``."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, _BLOCK)
        _TABLES[:] = [_powers(_BASES[0], size), _powers(pow(_BASES[0], -1, 1 << 64), size)]
    return _TABLES


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of the ``window`` words from each of ``starts`` on, by prefix sums."""
    power, inverse = _powers(base, len(words)), _powers(pow(base, -1, 1 << 64), len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power, dtype=np.uint64, out=sums[1:])
    return mix((sums[starts + window] - sums[starts]) * inverse[starts])


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each of the values differs from the one before it."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


class Run:
    """The documents of one run, ordered by id, their words and windows."""

    def __init__(self, docs: pa.Table, window: int):
        docs = docs.take(pc.sort_indices(docs["_num"])).combine_chunks()
        self.ids, self.numbers = docs["_id"], docs["_num"].to_numpy()
        texts = docs["_text"].cast(pa.large_binary()).combine_chunks()
        self.texts = texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        solid = ~_SPACE[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] |= solid[cuts]  # words never cross documents
        ends[cuts - 1] |= solid[cuts - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(begin, offsets)  # word numbers at which documents begin and end
        self.words = _word_hashes(data, begin, end)
        counts = np.diff(self.bounds)
        inside = np.ones(len(begin), bool)
        for stop, n in zip(self.bounds[1:].tolist(), counts.tolist()):
            inside[max(stop - window + 1, stop - n):stop] = False
        self.starts = np.flatnonzero(inside)  # words at which a window starts
        self.first = window_hashes(self.words, self.starts, window, _BASES[1])
        self.by = np.argsort(self.first)
        self.window = window

    def _short(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted 48-bit hashes of all windows, and where each distinct one begins."""
        short = self.first[self.by] & _COUNTED
        return short, np.flatnonzero(_changes(short))

    def counted(self) -> np.ndarray:
        """Distinct 48-bit window hashes, sorted."""
        short, at = self._short()
        return short[at]

    def candidates(self, shared: np.ndarray):
        """Windows that may repeat, ordered by hash and place.

        Returns their start words, document numbers, whether each begins a new hash, the
        distinct hashes (both parts), the least id of each, and whether it is asked for.
        """
        short, at = self._short()
        times = np.diff(np.append(at, len(short)))
        keep = np.repeat(shared | (times > 1), times)
        asked = np.repeat(shared, times)[keep]
        here = self.by[keep]
        group = np.cumsum(_changes(self.first[here])) - 1
        places = np.sort(group.astype(np.uint64) << np.uint64(32) | here.astype(np.uint64))
        here = (places & np.uint64(0xFFFFFFFF)).astype(np.int64)  # places ascend within a hash
        starts, first = self.starts[here], self.first[here]
        second = (window_hashes(mix(self.words.copy()), starts, self.window, _BASES[2]) >> np.uint64(32)).astype(np.uint32)
        new = _changes(first)
        if (~new[1:] & (second[1:] != second[:-1])).any():  # different windows of one first hash
            order = np.lexsort((starts, second, first))
            starts, first, second = starts[order], first[order], second[order]
            new = _changes(first) | _changes(second)
        at = np.flatnonzero(new)
        doc = np.searchsorted(self.bounds, starts, "right") - 1
        return starts, doc, new, first[at], second[at], self.numbers[doc[at]], asked[at]

    def removed(self, candidates: tuple, smaller: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per document its maximal removed intervals of words; ``smaller`` answers the asked hashes."""
        starts, doc, new, _, _, least, asked = candidates
        elsewhere = np.zeros(len(least), bool)
        elsewhere[asked] = smaller
        group = np.cumsum(new) - 1
        again = np.zeros(len(starts), bool)
        again[1:] = ~new[1:] & (doc[1:] == doc[:-1])  # the same document has it further left
        if len(starts):
            again |= elsewhere[group] | (self.numbers[doc] > least[group])
        delta = np.zeros(len(self.words) + 1, np.int32)
        delta[starts[again]] += 1  # places are distinct
        delta[starts[again] + self.window] -= 1
        covered = np.cumsum(delta[:-1]) > 0
        out = []
        for a, z in zip(self.bounds.tolist(), self.bounds[1:].tolist()):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:z], [0]]))) if covered[a:z].any() else ()
            out.append([(int(b), int(e)) for b, e in zip(edge[::2], edge[1::2])])
        return out


_ASK = "bucket int, run int, keys binary, more binary, ids binary"
_TELL = "run int, kind int, bucket int, data binary"


def _questions(run: int, buckets: int, keys: np.ndarray, more: np.ndarray | None = None,
               ids: np.ndarray | None = None) -> pa.Table:
    ends = cut(keys, buckets)
    parts = [(b, s, e) for b, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
    return pa.table({
        "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
        "run": pa.array([run] * len(parts), pa.int32()),
        "keys": pa.array([pack_sorted(keys[s:e]) for _, s, e in parts], pa.binary()),
        "more": pa.array([None if more is None else more[s:e].tobytes() for _, s, e in parts], pa.binary()),
        "ids": pa.array([None if ids is None else pack(ids[s:e]) for _, s, e in parts], pa.binary())})


def _tell(asked: pa.Table, kind: int, yes: np.ndarray, ends: np.ndarray) -> pa.Table:
    n = asked.num_rows
    return pa.table({"run": asked["run"], "kind": pa.array([kind] * n, pa.int32()), "bucket": asked["bucket"],
                     "data": pa.array([pack(np.packbits(yes[s:e])) for s, e in zip(ends, ends[1:])], pa.binary())})


@lean
def _count(asked: pa.Table) -> pa.Table:
    """Which hashes of a key range several runs have."""
    keys = [unpack_sorted(k) for k in asked["keys"].to_pylist()]
    ends = np.cumsum([0] + [len(k) for k in keys])
    every = np.concatenate(keys)
    by = np.argsort(every)
    times = np.diff(np.append(np.flatnonzero(_changes(every[by])), len(by)))
    yes = np.empty(len(by), bool)
    yes[by] = np.repeat(times > 1, times)
    return _tell(asked, 1, yes, ends)


@lean
def _least_owner(asked: pa.Table) -> pa.Table:
    """Which hashes of a key range another run has with a smaller id."""
    keys = [unpack_sorted(k) for k in asked["keys"].to_pylist()]
    ends = np.cumsum([0] + [len(k) for k in keys])
    every = np.concatenate(keys)
    more = np.frombuffer(b"".join(asked["more"].to_pylist()), np.uint32)
    ids = np.concatenate([unpack(i, np.int64) for i in asked["ids"].to_pylist()])
    by = np.lexsort((ids, more, every))
    new = _changes(every[by]) | _changes(more[by])
    yes = np.empty(len(by), bool)
    yes[by] = ids[by][np.flatnonzero(new)][np.cumsum(new) - 1] < ids[by]
    return _tell(asked, 2, yes, ends)


def _told(info: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of ``kind`` in the order of the asked keys."""
    out = np.zeros(len(keys), bool)
    ends = cut(keys, buckets)
    for k, b, data in zip(info["kind"].to_pylist(), info["bucket"].to_pylist(), info["data"].to_pylist()):
        if k == kind:
            n = ends[b + 1] - ends[b]
            out[ends[b]:ends[b + 1]] = np.unpackbits(unpack(data, np.uint8), count=n)
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    words = text.split()  # bytes split at ASCII white space only
    for b, e in reversed(spans):
        del words[b:e]
    return b" ".join(words)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _num (a long with the order of the ids, null ids least) and _text (null as empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    ident = F.col(id_col)
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        number = F.coalesce(ident.cast("long"), F.lit(_LEAST))
        return docs.select(ident.alias("_id"), number.alias("_num"), text)
    ids = materialize(docs.select(ident.cast("string").alias("_key")).distinct(), "ids")
    ranks = positions(ids, [], ["_key"]).select("_key", F.col("pos").alias("_num"))
    rows = docs.select(ident.alias("_id"), ident.cast("string").alias("_of"), text)
    return rows.join(ranks, F.col("_of").eqNullSafe(F.col("_key"))).select("_id", "_num", "_text")


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                            run_bytes: int = RUN_BYTES) -> DataFrame:
    """id, n_words, removed (array of begin, end in words), kept (the other words, joined by one space)."""
    if window < 1:
        raise ValueError("window must be at least 1 word")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _numbered(docs, id_col, text_col)
    runs = shared_sizes(rows, "_text", run_bytes)
    buckets = max(2, -(-runs // _RUNS_PER_BUCKET))
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("_num", "_text"), F.lit(runs)).cast("int"))
    tasks = -(-runs // _RUNS_PER_TASK)

    def spread(df: DataFrame, key: str) -> DataFrame:
        """``df`` dealt by ``key`` to enough tasks, where the session's number of partitions is too small for them."""
        return df.repartition(tasks, key) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df

    @lean
    def ask_count(table: pa.Table) -> pa.Table:
        return _questions(table["run"][0].as_py(), buckets, Run(table, window).counted())

    @lean
    def ask_owner(table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _questions(0, buckets, np.zeros(0, np.uint64))
        run = Run(table, window)
        *_, first, second, least, asked = run.candidates(_told(info, 1, run.counted(), buckets))
        return _questions(table["run"][0].as_py(), buckets, first[asked], second[asked], least[asked])

    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    @lean
    def remove(table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"_id": table["_id"], "n_words": pa.array([], pa.int64()), "removed": pa.array([], spans_type),
                             "kept": pa.array([], pa.string())})
        run = Run(table, window)
        found = run.candidates(_told(info, 1, run.counted(), buckets))
        first, asked = found[3], found[6]
        spans = run.removed(found, _told(info, 2, first[asked], buckets))
        return pa.table({
            "_id": run.ids, "n_words": pa.array(np.diff(run.bounds), pa.int64()),
            "removed": pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], spans_type),
            "kept": pa.array([_kept(t, s) for t, s in zip(run.texts.to_pylist(), spans)], pa.binary()).cast(pa.string())})

    dealt = spread(dealt, "run")
    asked = spread(dealt.groupBy("run").applyInArrow(ask_count, _ASK), "bucket")
    info = materialize(asked.groupBy("bucket").applyInArrow(_count, _TELL), "window-counts")
    release_shuffles(spark)
    asked = spread(dealt.groupBy("run").cogroup(spread(info, "run").groupBy("run")).applyInArrow(ask_owner, _ASK), "bucket")
    info = info.unionByName(materialize(asked.groupBy("bucket").applyInArrow(_least_owner, _TELL), "window-owners"))
    release_shuffles(spark)
    out = dealt.groupBy("run").cogroup(spread(info, "run").groupBy("run")).applyInArrow(
        remove, f"_id {kind}, n_words long, removed array<struct<begin:long,end:long>>, kept string")
    return out.withColumnRenamed("_id", id_col)
