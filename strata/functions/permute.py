"""Keyed permutations of 0..n-1, computed position by position."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiplications and shifts, modulo 2^64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed_permutation(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of ``at`` (0 <= at < n) in the permutation of 0..n-1 that ``key`` names.

    A balanced Feistel network permutes the 2b-bit numbers, the smallest such range that
    holds n; places beyond n walk on along their cycle until they are below it.  No place
    is looked up in a table or sorted, so any row finds its partner on its own.
    """
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        keys = _mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    + np.uint64(key % (1 << 64)))

        def step(x):
            left, right = x >> half, x & mask
            for k in keys:
                left, right = right, left ^ (_mix(right + k) & mask)
            return left << half | right

        out = step(np.asarray(at).astype(np.uint64))
        while True:
            beyond = np.flatnonzero(out >= np.uint64(n))
            if not len(beyond):
                return out.astype(np.int64)
            out[beyond] = step(out[beyond])


def permuted_places(at: Column, n: int, keys: list[int]) -> Column:
    """Array column: the place of ``at`` in the permutations of 0..n-1 of all ``keys``."""
    @F.pandas_udf("array<long>")
    def places(at: pd.Series) -> pd.Series:
        where = at.to_numpy(np.int64)
        return pd.Series(list(np.stack([keyed_permutation(where, n, k) for k in keys], axis=1)) if len(where) else [])
    return places(at)
