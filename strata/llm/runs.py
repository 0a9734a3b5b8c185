"""Runs of documents and questions about keys that are asked once per run.

Several operators need to know something about a hash key over the whole corpus
(how often it occurs, whether another document has it) for almost every position
of every text.  Asking per position would shuffle the corpus several times over.
Here documents are dealt to *runs* of a few MB by a hash of their id, every run
asks once per distinct key, and its keys travel as sorted, delta-coded, compressed
columns, cut by key range into buckets.  A bucket sees each key at most once per
run, however often it occurs, so no key is hot; it answers in the order of the
question, so answers need no keys.

``shared_sizes`` derives the number of runs and buckets from the bytes of the
input, so tasks stay at a few tens of MB at every scale.
"""

from __future__ import annotations

import gc
import math
import time

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text in a run, on average
RUN_BYTES = 6 << 20


def shared_sizes(docs: DataFrame, text_col: str, run_bytes: int = RUN_BYTES) -> int:
    """Number of runs (and of buckets): text bytes over ``run_bytes``, at least 2."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2, math.ceil(total / run_bytes))


def run_of(id_col: str, runs: int) -> Column:
    """Run of a document; a null id is hashed like any other value."""
    return F.pmod(F.xxhash64(F.lit("run"), F.col(id_col)), F.lit(runs)).cast("int")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs whose results are written."""
    for _ in range(2):  # what the first round frees may hold on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


# -- packed columns ---------------------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Byte planes of ``values``, compressed."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the buckets' slices in sorted 64-bit ``keys`` (equal ranges of the key space)."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


# -- hashing ----------------------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the key space (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_BLOCK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: a 64-bit value per byte, the same for both cases of A-Z
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers (at least) of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 65_536)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and for each text the end of its words.

    Words are what ASCII white space separates, A-Z lower-cased.  A word's hash is a
    polynomial over its bytes, taken as a difference of prefix sums, so a block of
    text is hashed by a few array operations.
    """
    parts = [t.encode() if t else b"" for t in texts]
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends_at = np.cumsum([len(p) + 1 for p in parts])
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + _BLOCK)
        while end < len(buf) and not _SPACE[buf[end - 1]]:  # blocks end behind a white space
            ahead = np.flatnonzero(_SPACE[buf[end:end + 65_536]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(len(buf), end + 65_536)
        block = buf[at:end]
        space = _SPACE[block]
        before = np.concatenate([[True], space[:-1]])
        start, stop = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        power, inverse = powers(len(block))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[block] * power[:len(block)], dtype=np.uint64)])
        hashes.append(mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        starts.append(start + at)
        at = end
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(where, ends_at)
