"""Exact quantiles (linear interpolation) for many columns in three scans.

The definition is the one of pandas / numpy / DuckDB ``quantile_cont``: position
p·(n−1) between the order statistics, linearly interpolated.

1. One aggregate sketches every column (count and ``percentile_approx``, whose rank
   error is bounded by n / accuracy).  The sketch brackets every wanted rank between
   two values of the column.
2. One scan counts the values below each bracket, and one groups the values inside
   it; running counts over them name the wanted order statistics.

A bracket holds about 4 n / accuracy values.  Where that is more than ``INSIDE``
values, the sketch is repeated inside the bracket first, so every round divides the
values that are left by about accuracy / 4 until a bracket holds no more than
``INSIDE`` of them; these are ordered in the cluster, and the driver receives one
value per bracket.  If counting shows that a bracket missed its rank, it is widened
and counted again.  No column's values meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import as_double

ACCURACY = 10_000
INSIDE = 100_000


class _Bracket:
    """Values lo..hi of a column, of which one is the order statistic ``rank`` (0-based)."""

    def __init__(self, column: int, rank: int, n: int, lo: float, hi: float):
        self.column, self.rank, self.n, self.lo, self.hi = column, rank, n, lo, hi
        self.outer = (lo, hi)
        self.below, self.inside, self.slack = 0, n, 2.0
        self.value: float | None = None

    def covers(self) -> bool:
        return self.below <= self.rank < self.below + self.inside

    def widen(self) -> None:
        (self.lo, self.hi), self.slack = self.outer, self.slack * 4

    def is_wide(self, most: int) -> bool:
        return self.value is None and self.inside > most

    def shares(self, accuracy: int) -> list[float]:
        """Shares of the bracket's values that enclose the wanted one."""
        slack = self.slack * (self.inside / accuracy + 1)
        return [min(1.0, max(0.0, (self.rank - self.below + d) / self.inside)) for d in (-slack, slack)]


def _narrow(base: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    """Count each bracket, settle ranks that fall on its ends, and sketch the rest for narrower ends."""
    aggs = []
    for k, b in enumerate(brackets):
        v = F.col(f"v{b.column}")
        aggs += [F.count_if(v < F.lit(b.lo)).alias(f"b{k}"), F.count_if(v == F.lit(b.lo)).alias(f"l{k}"),
                 F.count_if(v.between(F.lit(b.lo), F.lit(b.hi))).alias(f"i{k}"), F.count_if(v == F.lit(b.hi)).alias(f"h{k}")]
    row = base.agg(*aggs).first()
    rest = []
    for k, b in enumerate(brackets):
        b.below, b.inside = row[f"b{k}"], row[f"i{k}"]
        if not b.covers():
            b.widen()
        elif b.rank < b.below + row[f"l{k}"]:
            b.value = b.lo
        elif b.rank >= b.below + b.inside - row[f"h{k}"]:
            b.value = b.hi
        else:  # the ends are settled, so every round leaves less
            b.below, b.inside = b.below + row[f"l{k}"], b.inside - row[f"l{k}"] - row[f"h{k}"]
            b.lo, b.hi = math.nextafter(b.lo, math.inf), math.nextafter(b.hi, -math.inf)
            b.outer = (b.lo, b.hi)
            rest.append(b)
    if rest:
        row = base.agg(*[F.percentile_approx(
            F.when(F.col(f"v{b.column}").between(F.lit(b.lo), F.lit(b.hi)), F.col(f"v{b.column}")),
            F.array(*[F.lit(r) for r in b.shares(accuracy)]), accuracy).alias(f"s{k}") for k, b in enumerate(rest)]).first()
        for k, b in enumerate(rest):
            b.lo, b.hi = row[f"s{k}"]
            b.inside = min(b.inside, int(4 * b.slack * (b.inside / accuracy + 1)))  # until it is counted


def _read(base: DataFrame, brackets: list[_Bracket]) -> None:
    """Settles every rank that lies in its bracket; one row per bracket reaches the driver.

    The values of a bracket are counted where they are and ordered in the cluster: at
    most ``INSIDE`` distinct values share one sort, those of different brackets do not."""
    counts = []
    for k, b in enumerate(brackets):
        v = F.col(f"v{b.column}")
        counts += [F.count_if(v < F.lit(b.lo)).alias(f"b{k}"),
                   F.count_if(v.between(F.lit(b.lo), F.lit(b.hi))).alias(f"i{k}")]
    row = base.agg(*counts).first()
    for k, b in enumerate(brackets):
        b.below, b.inside = row[f"b{k}"], row[f"i{k}"]
    found = [b for b in brackets if b.covers()]
    for b in brackets:
        if not b.covers():
            b.widen()
            b.inside = b.n
    if not found:
        return
    cells = F.filter(F.array(*[
        F.when(F.col(f"v{b.column}").between(F.lit(b.lo), F.lit(b.hi)),
               F.struct(F.lit(k).alias("k"), F.col(f"v{b.column}").alias("v"), F.lit(b.rank - b.below).alias("at")))
        for k, b in enumerate(found)]), lambda x: x.isNotNull())
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    values = (base.select(F.inline(cells)).groupBy("k", "at", "v").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("upto", upto).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))))
    for r in values.select("k", "v").collect():
        found[r["k"]].value = r["v"]


def quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact",
              accuracy: int = ACCURACY, inside: int = INSIDE) -> dict:
    """{column: [quantile per prob]} (None for a column without values).

    ``method="approx"`` returns the sketch's values (``percentile_approx``) instead.
    """
    if not cols:
        return {}
    dts = {f.name: f.dataType for f in df.schema.fields}
    base = df.select(*[as_double(c, dts[c]).alias(f"v{i}") for i, c in enumerate(cols)])
    if method == "approx":
        row = base.agg(*[F.percentile_approx(f"v{i}", F.array(*[F.lit(p) for p in probs]), max(accuracy, 100_000))
                         .alias(f"q{i}") for i in range(len(cols))]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else None) for i, c in enumerate(cols)}
    # the first sketch asks for shares of unknown counts, so it takes the slack as a share
    slack = 2.0 / accuracy
    wanted = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    aggs = []
    for i in range(len(cols)):
        aggs += [F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
                 F.percentile_approx(f"v{i}", F.array(*[F.lit(w) for w in wanted]), accuracy).alias(f"s{i}")]
    row = base.agg(*aggs).first()
    brackets: dict[tuple[int, int], _Bracket] = {}
    for i in range(len(cols)):
        n = row[f"n{i}"]
        for j, p in enumerate(probs if n else []):
            at = p * (n - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                b = brackets.setdefault((i, rank), _Bracket(i, rank, n, row[f"lo{i}"], row[f"hi{i}"]))
                if n > 4 * accuracy:  # else the whole column is a small bracket
                    b.lo, b.hi = row[f"s{i}"][2 * j:2 * j + 2]
                    b.inside = int(4 * slack * n) + 2
    while todo := [b for b in brackets.values() if b.value is None]:
        wide = [b for b in todo if b.is_wide(inside)]
        if wide:
            _narrow(base, wide, accuracy)
        else:
            _read(base, todo)
    out = {}
    for i, c in enumerate(cols):
        n, found = row[f"n{i}"], []
        for p in probs if n else []:
            at = p * (n - 1)
            lo, hi = brackets[i, math.floor(at)].value, brackets[i, math.ceil(at)].value
            found.append(lo + (hi - lo) * (at - math.floor(at)))
        out[c] = found or None
    return out
