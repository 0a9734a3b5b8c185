"""Repeated-passage removal: suffixes grouped by hash digits, to the depth of one window.

A byte is removed when it is covered by a ``window``-byte string that also starts
in a document with a smaller id.  Which strings repeat is what the suffix array
of the corpus shows in its runs of equal ``window``-byte prefixes, and to see them
the suffixes need to be grouped only to that depth; no suffix is ordered by its text.
The groups are made by passes over 64-bit hash digits in place of text digits, and
after each pass a group whose suffixes all lie in one document is finished:

* first digit: the smallest hash of the ``gram``-byte strings inside the window.
  Neighbouring suffixes share it, so it is sorted once per stretch and not once
  per position, and equal windows have equal digits.
* second digit: the whole window.  Equal groups are exactly the repeated windows.

Only suffixes whose first digit occurs in several documents reach the second
pass.  A radix bucket is an equal range of the digit, mixed so that ranges hold alike
many; runs of documents (``runs``) send each digit once, so a passage that a third
of all documents share costs a bucket one entry per run.  Later exact copies of a whole text are found by
``exact_dedup`` first and need no passes: all their windows repeat.

Three jobs, each over whole texts: first digits, second digits, removal.  A task
holds one run (about 6 MB of text and some 20 times that in arrays, more if a
single document is larger) or one bucket.

Windows are compared by 64-bit hashes; among n different windows a false repeat
has probability n^2 / 2^65.

Defined results: null and empty texts have no bytes and no spans; texts shorter
than the window lose nothing; rows with the same id never remove each other's
bytes; null ids count as one id smaller than all others; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize
from strata.llm.exact_dedup import exact_dedup
from strata.llm.runs import (RUN_BYTES, cut, mix, pack, pack_sorted, release_shuffles, run_of, shared_sizes, unpack,
                             unpack_sorted)

WINDOW = 50
_BLOCK = 1 << 16
_LEAST = -(1 << 63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: low bits dropped from first digits; that pass is only a filter
_FIRST = np.uint64(0xFFFFFFFFFFFF0000)


def _eight(buf: np.ndarray, offset: int, n: int) -> np.ndarray:
    """The eight bytes from every position on, as one number (``buf`` is padded)."""
    return np.ndarray((n,), "<u8", buf, offset, (1,))


def _hash(buf: np.ndarray, at: slice | np.ndarray, n: int, length: int) -> np.ndarray:
    """64-bit hashes of the ``length``-byte strings that start at ``at``."""
    out, tmp = None, None
    for i, off in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
        word = _eight(buf, off, n)[at]
        if out is None:
            out, tmp = word ^ _ODD[0], np.empty(len(word), np.uint64)
        else:
            out ^= word
        out *= _ODD[i % 8]
        np.right_shift(out, np.uint64(32), tmp)
        out ^= tmp
    return mix(out)


def gram_of(window: int) -> int:
    return max(8, window * 16 // 25 // 8 * 8)


class Run:
    """The first copies of one run's texts, ordered by id, and their digits."""

    def __init__(self, docs: pa.Table, copies: set[tuple[int, bytes]], window: int):
        ids = np.array([_LEAST if i is None else i for i in docs.column(0).to_pylist()], np.int64)
        self.ids = [docs.column(0)[i].as_py() for i in range(len(ids))]
        self.texts = [b"" if t is None else t.encode() for t in docs.column(1).to_pylist()]
        flagged = {i for i, _ in copies}
        self.copy = [i in flagged and (i, hashlib.sha256(t).digest()) in copies for i, t in zip(ids.tolist(), self.texts)]
        self.order = [i for i in np.argsort(ids, kind="stable").tolist()
                      if not self.copy[i] and len(self.texts[i]) >= window]
        self.window = window
        lengths = np.array([len(self.texts[i]) for i in self.order], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        n = self.n = int(lengths.sum())
        self.buf = np.concatenate([np.frombuffer(b"".join([self.texts[i] for i in self.order]), np.uint8),
                                   np.zeros(2 * window + 16, np.uint8)])
        sorted_ids = ids[self.order] if self.order else np.zeros(0, np.int64)
        # starts of windows, document by document, and the smallest gram hash of each
        gram = gram_of(window)
        least = np.empty(n, np.uint64)
        for s in range(0, n, _BLOCK):
            e = min(n, s + _BLOCK)
            reach = min(n, e + window - gram)
            h = _hash(self.buf, slice(s, reach), n + window, gram)
            h = np.concatenate([h, np.full(e + window - gram - reach, np.iinfo(np.uint64).max, np.uint64)])
            step, width = 1, window - gram + 1
            while step * 2 <= width:
                h = np.minimum(h[:-step], h[step:])
                step *= 2
            if width > step:
                h = np.minimum(h[:len(h) - (width - step)], h[width - step:])
            least[s:e] = h[:e - s]
        valid = np.ones(n, bool)
        for end in self.ends.tolist():
            valid[end - window + 1:end] = False
        change = np.ones(n, bool)
        change[1:] = least[1:] != least[:-1]
        change[self.begins] = True
        self.stretch = np.flatnonzero(change & valid)  # starts of equal first digits
        stop = np.append(self.stretch[1:], n)
        last = self.ends[np.searchsorted(self.ends, self.stretch, "right")] - window + 1 if n else stop
        self.stop = np.minimum(stop, last)
        # a minimum leans towards small values; mixed again, digits fill equal ranges alike
        self.digit = mix(least[self.stretch]) & _FIRST
        self.owner = sorted_ids[np.searchsorted(self.ends, self.stretch, "right")] if n else np.zeros(0, np.int64)
        # distinct digits, and whether several ids of this run have them
        by = np.argsort(self.digit)
        d = self.digit[by]
        first = np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else np.zeros(0, bool)
        self.digits = d[first]
        group = np.cumsum(first) - 1
        self.of_stretch = np.empty(len(by), np.int64)
        self.of_stretch[by] = group
        at = np.flatnonzero(first)
        own = self.owner[by]
        self.inside = (np.maximum.reduceat(own, at) != np.minimum.reduceat(own, at)) if len(at) else np.zeros(0, bool)

    def second(self, shared: np.ndarray):
        """Windows with a repeated first digit: positions, ids, their distinct hashes with the smallest id."""
        keep = (shared | self.inside)[self.of_stretch]
        length = (self.stop - self.stretch)[keep]
        total = int(length.sum())
        start = np.repeat(self.stretch[keep] - np.concatenate([[0], np.cumsum(length)[:-1]]) if total else
                          np.zeros(0, np.int64), length if total else np.zeros(0, np.int64))
        pos = start + np.arange(total)
        asked = np.repeat(shared[self.of_stretch][keep], length)
        hashes = np.empty(total, np.uint64)
        for s in range(0, total, _BLOCK):
            hashes[s:s + _BLOCK] = _hash(self.buf, pos[s:s + _BLOCK], self.n + self.window, self.window)
        owner = np.repeat(self.owner[keep], length)
        by = np.argsort(hashes)
        h = hashes[by]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if total else np.zeros(0, bool)
        group = np.empty(total, np.int32)
        group[by] = np.cumsum(first, dtype=np.int32) - 1
        at = np.flatnonzero(first)
        least = np.minimum.reduceat(owner[by], at) if total else owner
        return pos, owner, group, h[at], least, asked[by[at]]

    def removed(self, pos: np.ndarray) -> list[np.ndarray]:
        """Per ordered document the covered spans (begin, end) of windows that start at ``pos``."""
        delta = np.zeros(self.n + self.window + 1, np.int32)
        delta[pos] += 1  # positions are distinct
        delta[pos + self.window] -= 1
        covered = np.cumsum(delta[:self.n], dtype=np.int32) > 0
        edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # spans of neighbouring documents can touch; windows never cross, so cut at the ends
        inner = self.ends[:-1]
        split = inner[covered[inner - 1] & covered[inner]] if len(inner) else inner
        begin, end = np.sort(np.concatenate([begin, split])), np.sort(np.concatenate([end, split]))
        which = np.searchsorted(self.ends, begin, "right")
        spans = np.stack([begin, end], axis=1)
        bounds = np.searchsorted(which, np.arange(len(self.order) + 1))
        return [spans[a:z] - b for a, z, b in zip(bounds, bounds[1:], self.begins.tolist())]


def _questions(run: int, keys: np.ndarray, buckets: int, ids: np.ndarray | None = None) -> pa.Table:
    ends = cut(keys, buckets)
    slices = [(b, s, e) for b, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]
    return pa.table({
        "bucket": pa.array([b for b, _, _ in slices], pa.int32()),
        "run": pa.array([run] * len(slices), pa.int32()),
        "keys": pa.array([pack_sorted(keys[s:e]) for _, s, e in slices], pa.binary()),
        "ids": pa.array([None if ids is None else pack(ids[s:e]) for _, s, e in slices], pa.binary())})


_ASK = "bucket int, run int, keys binary, ids binary"
_TELL = "run int, kind int, bucket int, id long, data binary"


def _answers(kind: int):
    """Per question of a bucket: which keys other runs have (with a smaller id, if ids are sent)."""
    def run(asked: pa.Table) -> pa.Table:
        runs, buckets = asked["run"].to_pylist(), asked["bucket"].to_pylist()
        keys = [unpack_sorted(k) for k in asked["keys"].to_pylist()]
        ends = np.cumsum([0] + [len(k) for k in keys])
        every = np.concatenate(keys)
        if kind == 1:
            by = np.argsort(every, kind="stable")
        else:
            ids = np.concatenate([unpack(i, np.int64) for i in asked["ids"].to_pylist()])
            by = np.lexsort((ids, every))
        k = every[by]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        yes = np.empty(len(k), bool)
        at = np.flatnonzero(first)
        if kind == 1:
            size = np.diff(np.append(at, len(k)))
            yes[by] = np.repeat(size > 1, size)
        else:
            smallest = np.repeat(ids[by][at], np.diff(np.append(at, len(k))))
            yes[by] = smallest < ids[by]
        data = [pack(np.packbits(yes[s:e])) for s, e in zip(ends, ends[1:])]
        return pa.table({"run": pa.array(runs, pa.int32()), "kind": pa.array([kind] * len(runs), pa.int32()),
                         "bucket": pa.array(buckets, pa.int32()), "id": pa.array([None] * len(runs), pa.int64()),
                         "data": pa.array(data, pa.binary())})
    return run


def _told(info: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of ``kind`` in the order of the keys that were asked."""
    out = np.zeros(len(keys), bool)
    ends = cut(keys, buckets)
    for k, b, data in zip(info["kind"].to_pylist(), info["bucket"].to_pylist(), info["data"].to_pylist()):
        if k == kind:
            n = ends[b + 1] - ends[b]
            out[ends[b]:ends[b + 1]] = np.unpackbits(unpack(data, np.uint8), count=n).astype(bool)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   run_bytes: int = RUN_BYTES) -> DataFrame:
    """id, n_bytes, removed (array of begin, end in bytes), kept (the remaining bytes)."""
    if window < 16:
        raise ValueError("window must be at least 16 bytes")
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    runs = shared_sizes(narrow, "_text", run_bytes)
    dealt = narrow.withColumn("run", run_of("_id", runs))
    # exact_dedup would keep a real id before a null one; as the least id a null is always kept
    numbered = narrow.withColumn("_id", F.coalesce("_id", F.lit(_LEAST)))
    copies = (exact_dedup(numbered, "_id", "_text", keep="smallest").where("NOT kept")
              .select(run_of("_id", runs).alias("run"), F.lit(0).alias("kind"), F.lit(0).alias("bucket"),
                      F.col("_id").alias("id"), F.unhex("text_sha256").alias("data")))
    copies = materialize(copies, "later-copies")
    release_shuffles(spark)

    def load(table: pa.Table, info: pa.Table) -> Run:
        later = {(i, d) for k, i, d in zip(info["kind"].to_pylist(), info["id"].to_pylist(),
                                           info["data"].to_pylist()) if k == 0}
        return Run(table.select(["_id", "_text"]), later, window)

    def grouped(info: DataFrame, fn, schema: str) -> DataFrame:
        return dealt.groupBy("run").cogroup(info.groupBy("run")).applyInArrow(fn, schema)

    def ask_first(table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _questions(0, np.zeros(0, np.uint64), runs)
        return _questions(table["run"][0].as_py(), load(table, info).digits, runs)

    def ask_second(table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _questions(0, np.zeros(0, np.uint64), runs, np.zeros(0, np.int64))
        run = load(table, info)
        _, _, _, keys, ids, asked = run.second(_told(info, 1, run.digits, runs))
        return _questions(table["run"][0].as_py(), keys[asked], runs, ids[asked])

    def remove(table: pa.Table, info: pa.Table) -> pa.Table:
        spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        if not table.num_rows:
            return pa.table({"_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()),
                             "removed": pa.array([], spans_type), "kept": pa.array([], pa.binary())})
        run = load(table, info)
        pos, owner, group, keys, ids, asked = run.second(_told(info, 1, run.digits, runs))
        elsewhere = np.zeros(len(keys), bool)
        elsewhere[asked] = _told(info, 2, keys[asked], runs)
        spans: list = [[] for _ in run.texts]
        if len(pos):
            repeated = pos[elsewhere[group] | (owner > ids[group])]
            for i, s in zip(run.order, run.removed(repeated)):
                spans[i] = s.tolist()
        kept = []
        for i, text in enumerate(run.texts):
            if run.copy[i] and len(text) >= window:
                spans[i] = [[0, len(text)]]
            at, parts = 0, []
            for begin, end in spans[i]:
                parts.append(text[at:begin])
                at = end
            kept.append(b"".join([*parts, text[at:]]))
        return pa.table({"_id": pa.array(run.ids, pa.int64()),
                         "n_bytes": pa.array([len(t) for t in run.texts], pa.int64()),
                         "removed": pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], spans_type),
                         "kept": pa.array(kept, pa.binary())})

    info = copies
    for kind, ask in ((1, ask_first), (2, ask_second)):
        info = info.unionByName(materialize(
            grouped(info, ask, _ASK).groupBy("bucket").applyInArrow(_answers(kind), _TELL), "answers"))
        release_shuffles(spark)
    return grouped(info, remove, "_id long, n_bytes long, removed array<struct<begin:long,end:long>>, kept binary"
                   ).withColumnRenamed("_id", id_col)
