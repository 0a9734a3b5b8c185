"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote junk, good or abstain on every document
   (symbols, capitals, repeated words, exclamation marks, menu bars, sentence
   length, word variety, word length).
2. The votes of all documents are counted by pattern (at most 3^8 patterns) and
   expectation-maximisation estimates how often each labeller votes what on good
   and on junk documents, and from that the posterior of every pattern.
3. The posterior labels train a hashed linear scorer (logistic regression over
   hashed 4-grams of character shapes and word-repeat marks), so a document that
   every labeller abstains on is still scored.

Only the scorer's training set is a sample: documents whose id hashes below a
cutoff, about ``SAMPLE`` and never more than twice that.  Votes and counts cover
all documents, and all documents are scored over their whole texts, in a scan.

Defined results: null and empty texts carry no vote and no feature, so their
score is that of the model's intercept; repeated rows score alike and vote each
time; an empty table gives an empty result; without any junk (or any good) votes
every document gets the posterior of its class; extra columns are passed on by
``filter_quality``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import give_back, materialize, slices, small_batches

JUNK, GOOD, ABSTAIN = 0, 1, 2
LABELLERS = ("symbols", "capitals", "repeats", "exclaims", "menu", "sentences", "variety", "word_length")
SAMPLE = 6_000
#: documents are kept from this probability on; below 0.5, as a lost good document costs more
KEEP_FROM = 0.3
BITS = 16
_SYMBOLS = np.frombuffer(b"*&%$#|~^=<>{}[]\\_@+`", np.uint8)


def _vote(value: float, good_below: float, junk_above: float) -> int:
    return JUNK if value > junk_above else GOOD if value < good_below else ABSTAIN


def votes(text: bytes) -> str:
    """One digit per labeller: 0 junk, 1 good, 2 abstain."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    out = [_vote(hist[_SYMBOLS].sum() / max(1, len(text)), 0.005, 0.02) if n else ABSTAIN]
    if n < 5:
        return "".join(map(str, out + [ABSTAIN] * (len(LABELLERS) - 1)))
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    out.append(_vote(upper / max(1, upper + lower), 0.15, 0.3))
    out.append(_vote(sum(map(operator.eq, words, words[1:])) / (n - 1), 0.03, 0.1))
    out.append(_vote(hist[33] / n, 0.03, 0.15))
    out.append(_vote(hist[124] / n, 0.01, 0.05))
    out.append(_vote(n / (1 + hist[46] + hist[63] + hist[33]), 40, 60))
    variety = len(set(words)) / n ** 0.5
    out.append(ABSTAIN if n < 20 else _vote(-variety, -3.0, -2.0))
    length = len(text) / n - 1
    out.append(_vote(abs(length - 6), 4, 7))
    return "".join(map(str, out))


# -- hashed features --------------------------------------------------------------------------

_SHAPE = np.full(256, 1, np.uint32)  # letters, and all bytes beyond ASCII
_SHAPE[:33] = 2
_SHAPE[10] = 3
_SHAPE[48:58] = 4
_SHAPE[65:91] = 5
for _i, _ch in enumerate(b".,!?;:'\"-()|*&%$#=<>/\\[]{}_@+~^`"):
    _SHAPE[_ch] = 6 + _i
_SHAPE[127] = 2
_MIX = np.uint32(2654435761)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the hashed features: square roots of relative frequencies."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0)
    shape = _SHAPE[np.frombuffer(text, np.uint8)]
    padded = np.concatenate([[0, 0, 0], shape]).astype(np.uint32)
    gram = ((padded[:-3] * np.uint32(64) + padded[1:-2]) * np.uint32(64) + padded[2:-1]) * np.uint32(64) + padded[3:]
    counts = np.bincount((gram * _MIX) >> np.uint32(32 - BITS), minlength=1 << BITS)
    words = text.split()
    same = sum(map(operator.eq, words, words[1:]))
    index = np.flatnonzero(counts)
    # short texts say little, so they stay near the intercept
    scale = (len(text) / (len(text) + 200)) ** 0.5
    value = np.sqrt(counts[index] / len(text)) * scale
    mark = [(1 << BITS), (1 << BITS) + 1]  # word repeats, distinct words
    extra = [scale * x for x in ((same / max(1, len(words) - 1)) ** 0.5, (len(set(words)) / max(1, len(words))) ** 0.5)]
    return np.concatenate([index, mark]).astype(np.int32), np.concatenate([value, extra])


DIMS = (1 << BITS) + 2


# -- weak labels ------------------------------------------------------------------------------

def em_posteriors(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """P(good) of every vote pattern, from counts of all documents.

    Latent classes: good, and one kind of junk per labeller.  Kinds of junk exclude
    each other more often than not (a repeated word is rarely a menu), so a single
    junk class would count the good votes of seven labellers against the one that
    recognises the kind.  Every class has its own vote frequencies per labeller.
    """
    if not patterns:
        return {}
    keys = list(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    v = np.array([[int(ch) for ch in k] for k in keys])
    m = v.shape[1]
    onehot = (v[:, :, None] == np.arange(2)).astype(float)  # pattern, labeller, vote; abstaining says nothing
    accused = (v == JUNK).astype(float)
    belief = np.concatenate([np.where(accused.any(axis=1), 0.1, 0.95)[:, None], accused + 1e-3], axis=1)
    belief[:, 1:] *= ((1 - belief[:, 0]) / belief[:, 1:].sum(axis=1))[:, None]
    prior = np.empty((m + 1, m, 2))
    prior[:, :, JUNK], prior[:, :, GOOD] = 0.1, 1.0
    # labellers rarely accuse good documents: as if half as many more were seen that none accuses.
    # Without it, "an odd kind of good document" explains a kind of junk that one labeller alone sees as well.
    prior[0, :, GOOD] = 1 + weight.sum() / 2
    for j in range(m):
        prior[j + 1, j] = 10.0, 0.01  # kind j is what labeller j accuses
    for _ in range(rounds):
        mass = weight[:, None] * belief
        share = (mass.sum(axis=0) + 1e-3) / (mass.sum() + 1e-3 * (m + 1))
        counts = np.einsum("pc,plv->clv", mass, onehot) + prior
        logp = np.einsum("plv,clv->pc", onehot, np.log(counts / counts.sum(axis=2, keepdims=True))) + np.log(share)
        new = np.exp(logp - logp.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - belief).max() < 1e-9
        belief = new
        if done:
            break
    return dict(zip(keys, belief[:, 0].tolist()))


def _fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 800,
                ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets (accelerated gradient descent over sparse rows)."""
    lengths = np.array([len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(DIMS), float(np.log(target.mean() + 1e-6) - np.log(1 - target.mean() + 1e-6))
    prev_w, prev_b, rate = w, b, 1.5
    for k in range(1, steps + 1):
        mom = (k - 1) / (k + 2)
        yw, yb = w + mom * (w - prev_w), b + mom * (b - prev_b)
        z = np.bincount(row, value * yw[index], len(rows)) + yb
        r = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        prev_w, prev_b = w, b
        w = yw - rate * (np.bincount(index, value * r[row], DIMS) / len(rows) + ridge * yw)
        b = yb - rate * r.mean()
    return w, b


@dataclass
class QualityModel:
    weights: np.ndarray
    intercept: float
    posteriors: dict[str, float]

    def score(self, text: str | None) -> float:
        index, value = hashed((text or "").encode())
        z = float(self.weights[index] @ value) + self.intercept
        return 1 / (1 + np.exp(-max(-500.0, min(500.0, z))))


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Votes of all documents, EM over their patterns, scorer on the bounded sample."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    n = narrow.select("_id").count()
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 0) for b in batches):
            patterns, index, value = [], [], []
            for text, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                patterns.append(votes(data))
                i, v = hashed(data) if chosen else (None, None)
                index.append(i)
                value.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(patterns, pa.string()), pa.array(index, pa.list_(pa.int32())),
                 pa.array(value, pa.list_(pa.float64()))], ["pattern", "idx", "val"])
        give_back()

    voted = materialize(narrow.select("_text", share.alias("_chosen")).mapInArrow(
        run, "pattern string, idx array<int>, val array<double>"), "quality-votes")
    counted = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}  # <= 3^8 rows
    posteriors = em_posteriors(counted)
    rows = voted.where("idx IS NOT NULL").limit(2 * sample).toArrow()
    if rows.num_rows == 0:
        mean = sum(posteriors[k] * c for k, c in counted.items()) / max(1, sum(counted.values()))
        return QualityModel(np.zeros(DIMS), float(np.log(mean + 1e-6) - np.log(1 - mean + 1e-6)), posteriors)
    target = np.array([posteriors[k] for k in rows["pattern"].to_pylist()])
    idx, val = rows["idx"].combine_chunks(), rows["val"].combine_chunks()
    ends = np.asarray(idx.offsets)
    flat_i, flat_v = np.asarray(idx.values), np.asarray(val.values)
    sparse = [(flat_i[a:b], flat_v[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    w, b = _fit_linear(sparse, target)
    del rows, sparse, idx, val, flat_i, flat_v
    give_back()
    return QualityModel(w, b, posteriors)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                  keep_from: float = KEEP_FROM) -> DataFrame:
    """id, score (probability of being good), keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 1) for b in batches):
            scores = [float(shared.value.score(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([s >= keep_from for s in scores])],
                [id_col, "score", "keep"])
        give_back()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, keep boolean")


def filter_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``keep_from``; one scan, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, at) for b in batches):
            keep = [shared.value.score(t) >= keep_from for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
