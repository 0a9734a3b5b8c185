"""Toxicity by compression distance with zstandard dictionaries.

Training (on a bounded sample of labelled rows, each with its whole text):

1. The *ordinary* dictionary is trained on windows of ordinary texts.
2. The *toxic* dictionary consists of the parts of words that toxic texts use
   and ordinary texts (almost) never do.  Without that restriction it would be
   filled with the ordinary language that both classes share.  A part counts if
   its use by both classes alike is less likely than ``CHANCE`` (an absolute test:
   more training rows find rarer terms) or, in small samples, if it is in 3 % of
   the toxic texts.  Every part that counts is in the dictionary once, the commonest
   last, and the size is theirs; zstandard's own trainer would leave some out.
3. A window is compressed with the ordinary dictionary alone and with the
   ordinary and the toxic dictionary together; the difference of the two lengths
   says how much the toxic dictionary explains.  Matches shorter than
   ``MIN_MATCH`` bytes are switched off, so chance matches save nothing.
4. A logistic calibration over the window differences of a text (largest three,
   counts above thresholds, mean, number of windows), fitted on sample rows that
   the dictionaries were not trained on, turns them into a probability.  Tasks
   compute these numbers over whole texts, as in scoring; only they reach the driver.

Scoring is a scan over whole texts: every window of every text, no shuffle.

Bounds of the training sample: ``max_toxic`` and ``max_ordinary`` texts, the rows
with the smallest hash of their id, so it does not depend on partitioning.  No text
is cut.  The dictionaries are trained (on the driver) on all windows of their rows; only
if a caller names ``max_windows``, on a random draw of about so many over all of them,
with one rate for both classes and every position of every text, seeded by the ids.

Defined results: null and empty texts are one empty window; repeated rows score
alike; of several labels of one id the largest counts, of several texts the least; rows with null labels are
not learned from; if the sample lacks a class every score is the share of toxic
rows (0 without labels); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize, slices

WINDOW, STRIDE = 64, 32
MIN_MATCH = 5
LEVEL = 3
#: sizes of the ordinary dictionary, and of the toxic one if no part of a word marks the class
ORDINARY_BYTES, FALLBACK_BYTES = 16_384, 1_024
#: probability below which a word part's use in toxic texts is no accident; far below one in
#: the number of parts, since near copies among the texts count it several times
CHANCE = 1e-12
MAX_TOXIC, MAX_ORDINARY = 2_000, 6_000
#: part of the sample (in tenths) that calibrates instead of training dictionaries
CALIBRATE = 4
_GRAMS = (4, 5, 6, 7)
_ABOVE = (2, 3, 4, 5, 6, 8)


def windows(text: bytes) -> list[bytes]:
    if len(text) <= WINDOW:
        return [text]
    return [text[i:i + WINDOW] for i in range(0, len(text) - WINDOW + STRIDE, STRIDE)]


def window_count(n_bytes: int) -> int:
    return 1 if n_bytes <= WINDOW else -(-(n_bytes - WINDOW) // STRIDE) + 1


def draw(text: bytes, seed: int, rate: float) -> list[bytes]:
    """Passages of ``text`` made of the windows drawn with ``rate``; words cut at their edges are left out."""
    if rate >= 1 or len(text) <= WINDOW:
        return [text] if rate >= 1 or np.random.default_rng(seed).random() < rate else []
    on = np.random.default_rng(seed).random(window_count(len(text))) < rate
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    out = []
    for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        begin, end = a * STRIDE, min(len(text), (z - 1) * STRIDE + WINDOW)
        piece = text[begin:end]
        if begin and piece.strip() and not (text[begin - 1:begin].isspace() or piece[:1].isspace()):
            piece = piece.split(None, 1)[-1]
        if end < len(text) and piece.strip() and not (text[end:end + 1].isspace() or piece[-1:].isspace()):
            piece = piece.rsplit(None, 1)[0]
        out.append(piece)
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_FAST,
        write_content_size=False, write_dict_id=False, write_checksum=False)
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)


def _trained(samples: list[bytes], size: int) -> bytes:
    """Bytes of a dictionary trained on ``samples``; the samples themselves if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" "


def _word_counts(texts: list[bytes]) -> Counter:
    """Texts in which each word occurs (with the blank before it)."""
    out: Counter = Counter()
    for text in texts:
        out.update({b" " + w for w in text.split()})
    return out


def _gram_counts(words: Counter, only: Counter | None = None) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        for gram in {word[i:i + k] for k in _GRAMS for i in range(len(word) - k + 1)}:
            if only is None or gram in only:
                out[gram] += n
    return out


def chance(n: int, other: int, share: float) -> float:
    """Probability that ``n`` or more of ``n + other`` uses are toxic if a use is toxic with ``share``."""
    total = n + other
    if share >= 1:
        return 1.0
    return sum(math.exp(math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1)
                        + i * math.log(share) + (total - i) * math.log1p(-share)) for i in range(n, total + 1))


def _marked(toxic: list[bytes], ordinary: list[bytes]) -> list[list[bytes]]:
    """Per toxic text, the parts of each of its words made of grams that mark the class."""
    counts = Counter({g: n for g, n in _gram_counts(_word_counts(toxic)).items() if n >= 5})
    other = _gram_counts(_word_counts(ordinary), counts)
    least = max(5, 0.03 * len(toxic))
    ratio = 0.01 * max(1, len(ordinary)) / max(1, len(toxic))
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    marks = {g for g, n in counts.items() if (n >= least and other[g] <= n * ratio)
             or (other[g] <= max(1, n * ratio) and chance(n, other[g], share) < CHANCE)}
    cache: dict[bytes, bytes] = {}

    def part(word: bytes) -> bytes:
        if word not in cache:
            keep = bytearray(len(word))
            for k in _GRAMS:
                for i in range(len(word) - k + 1):
                    if word[i:i + k] in marks:
                        keep[i:i + k] = b"\1" * k
            cache[word] = bytes(b for b, on in zip(word, keep) if on)
        return cache[word]

    return [[p for w in t.split() if (p := part(b" " + w))] for t in toxic]


def toxic_parts(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Per toxic text, the parts of its words made of grams that mark the class."""
    return [s for parts in _marked(toxic, ordinary) if (s := b"".join(parts))]


def toxic_dictionary(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Every marked part once, the commonest last, where matches are nearest."""
    known = Counter(p for parts in _marked(toxic, ordinary) for p in sorted(set(parts)))
    return b"".join(p for p, _ in reversed(known.most_common())) or _trained(toxic, FALLBACK_BYTES)


@dataclass
class ToxicityModel:
    """Two dictionaries and the calibration; small enough to travel with a task."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    prior: float

    def scorer(self):
        if not self.weights:
            return lambda text: self.prior
        plain, both = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        weights = np.array(self.weights)

        def score(text: str | None) -> float:
            z = float(features((text or "").encode().lower(), plain, both) @ weights)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def features(text: bytes, plain, both) -> np.ndarray:
    cut = windows(text)
    gain = np.fromiter((len(plain.compress(w)) - len(both.compress(w)) for w in cut), float, len(cut))
    top = np.concatenate([np.sort(gain)[::-1][:3], np.zeros(max(0, 3 - len(gain)))])
    return np.array([1.0, *top, math.log(len(gain)),
                     *(math.log1p((gain >= k).sum()) for k in _ABOVE), gain.mean()])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary from the drawn passages of each text."""
    cut = [w for t in ordinary for p in t for w in windows(p)]
    plain = _trained(cut, ORDINARY_BYTES)
    toxic, ordinary = ([b" ".join(t) for t in texts if t] for texts in (toxic, ordinary))
    return plain, toxic_dictionary(toxic, ordinary)


def _drawn(sample: DataFrame, rate: float) -> DataFrame:
    """label and drawn passages of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, 3) for b in batches):
            order, ids, label, texts = batch.columns
            parts = [draw(t.encode().lower(), _seed(i), rate) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
            yield pa.RecordBatch.from_arrays([order, ids, label, pa.array(parts, pa.list_(pa.binary()))],
                                             ["_h", "_id", "_label", "parts"])

    kind = dict(sample.dtypes)["_id"]
    return sample.mapInArrow(run, f"_h long, _id {kind}, _label int, parts array<binary>")


def _featured(sample: DataFrame, plain: bytes, extra: bytes) -> DataFrame:
    """label and features of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _compressor(plain), _compressor(plain + extra)
        for batch in chain.from_iterable(slices(b, 3) for b in batches):
            order, ids, label, texts = batch.columns
            x = [features(t.encode().lower(), one, two).tolist() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([order, ids, label, pa.array(x, pa.list_(pa.float64()))],
                                             ["_h", "_id", "_label", "x"])

    kind = dict(sample.dtypes)["_id"]
    return sample.mapInArrow(run, f"_h long, _id {kind}, _label int, x array<double>")


def _seed(key) -> int:
    return zlib.crc32(str(key).encode())


def _calibrates(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 10 < CALIBRATE


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC,
                 max_ordinary: int = MAX_ORDINARY, max_windows: int | None = None) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows for which ``learn`` (on the id) holds."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
                          & (F.lit(True) if learn is None else learn))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")))
    totals = dict(known.groupBy("_label").count().collect())  # two rows
    prior = totals.get(1, 0) / max(1, totals.get(1, 0) + totals.get(0, 0))
    order = F.abs(F.xxhash64("_id"))
    chosen = None
    for value, most in ((1, max_toxic), (0, max_ordinary)):
        part = known.where(F.col("_label") == value).withColumn("_h", order).orderBy("_h", "_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most max_toxic + max_ordinary rows of three numbers, and their whole texts on shared storage
    sample = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
              .join(F.broadcast(chosen), "_id").groupBy("_h", "_id", "_label").agg(F.min("_text").alias("_text")))
    sample = materialize(sample, "toxicity-sample")
    held = _calibrates(F.col("_id"))
    size = F.octet_length("_text")
    count = F.greatest(F.lit(1), F.ceil((size - WINDOW) / STRIDE) + 1)
    found = {(r["held"], r["_label"]): r["n"] for r in
             sample.groupBy(held.alias("held"), "_label").agg(F.sum(count).alias("n")).collect()}  # four rows
    if len(found) < 4:
        return ToxicityModel(b" ", b" ", [], prior)
    rate = 1.0 if max_windows is None else max_windows / (found[False, 0] + found[False, 1])
    texts = sorted(_drawn(sample.where(~held), rate).collect(), key=lambda r: (r["_h"], r["_id"]))
    plain, extra = train_dictionaries(*([list(map(bytes, r["parts"])) for r in texts if r["_label"] == k] for k in (1, 0)))
    rows = sorted(_featured(sample.where(held), plain, extra).collect(), key=lambda r: (r["_h"], r["_id"]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["_label"] for r in rows], float)
    # each class weighs as much as it does among all labelled rows
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return ToxicityModel(plain, extra, _logistic(x, y, weight).tolist(), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 from 0.5 on) for every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in chain.from_iterable(slices(b, 1) for b in batches):
            ids, texts = batch.columns
            scores = [score(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                [id_col, "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, predicted int")
