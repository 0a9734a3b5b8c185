"""Language-model scoring by deleted interpolation.

The probability of a token after another is a mixture of three estimates: the
maximum-likelihood bigram, the maximum-likelihood unigram and a uniform share of
the vocabulary.  The mixture weights depend on how often the context occurred
(one set per power of two) and are learned by expectation-maximisation: part of
the learning documents is deleted from the counts, and the weights maximise the
likelihood of that part under the counts of the rest.  Scores use all counts.

1. Every run of documents (``runs``) counts its distinct words and word pairs and
   asks for their totals; buckets of the key space add up and answer.  Every
   document is counted, and what is gathered grows with the corpus.
2. The deleted documents are compared with the counts of the rest: a histogram of
   (context frequency, bigram share, unigram share) in steps of 1/16 of a decade,
   whose size does not depend on the corpus, is all that EM needs.
3. Every run scores its documents with the answers to its own question.

A task holds one run (about 8 MB of text) or one bucket; a word that makes up a
third of the corpus is one entry per run.

Tokens are what ASCII white space separates, A-Z lower-cased, then one end token;
the end token also is the context of a text's first token.

Defined results: null and empty texts are just the end token; repeated rows count
and score one by one; rows without an id are scored but not learned from unless
``learn`` says so; without learning documents the model is uniform over one
unknown word; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize
from strata.llm.runs import (cut, mix, pack, pack_sorted, release_shuffles, run_of, shared_sizes, unpack,
                             unpack_sorted, word_hashes)

RUN_BYTES = 8 << 20
COUNTED, DELETED, OTHER = 0, 1, 2
_END = np.uint64(0x5851F42D4C957F2D)
_ONE = np.uint64(1)
#: histogram steps per decade
_STEPS = 16
_ROUNDS = 100


class _Tokens:
    """Word and pair keys of the documents of a run."""

    def __init__(self, texts: list[str | None]):
        words, ends = word_hashes(texts)
        begins = np.concatenate([[0], ends[:-1]])
        self.lengths = ends - begins + 1
        self.ends = np.cumsum(self.lengths)
        tokens = np.full(int(self.lengths.sum()), _END, np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(texts)), ends - begins)] = words
        context = np.empty_like(tokens)
        if len(tokens):
            context[0] = _END
            context[1:] = tokens[:-1]  # the token before a first token is the end of another text
        self.owner = np.repeat(np.arange(len(texts)), self.lengths)
        # the lowest bit tells words (1) from pairs (0)
        self.words = mix(tokens.copy()) | _ONE
        self.pairs = mix(mix(context * np.uint64(0x9E3779B97F4A7C15)) + tokens) & ~_ONE
        self.end_key = (mix(np.array([_END])) | _ONE)[0]
        self.first = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys (with the end token's), and their places for words and pairs of every token."""
        every = np.concatenate([self.words, self.pairs, [self.end_key]])
        keys, places = np.unique(every, return_inverse=True)
        return keys, places

    def contexts(self, of_words: np.ndarray, end_value) -> np.ndarray:
        """Values of the context of every token, from the values of the tokens."""
        out = np.empty_like(of_words)
        if len(out):
            out[1:] = of_words[:-1]
            out[self.first] = end_value
        return out


def _question(run: int, kind: int, keys: np.ndarray, counts: list[np.ndarray] | None, buckets: int) -> dict:
    ends = cut(keys, buckets)
    rows = {"bucket": [], "run": [], "kind": [], "keys": [], "counts": []}
    for b, (s, e) in enumerate(zip(ends, ends[1:])):
        if e > s:
            rows["bucket"].append(b)
            rows["run"].append(run)
            rows["kind"].append(kind)
            rows["keys"].append(pack_sorted(keys[s:e]))
            rows["counts"].append(None if counts is None else pack(np.concatenate([c[s:e] for c in counts])))
    return rows


_ASK = pa.schema([("bucket", pa.int32()), ("run", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()),
                  ("counts", pa.binary())])
_TELL = pa.schema([("run", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
_ALL_KEYS, _DELETED_KEYS, _TOTALS = 0, 1, 2


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of a bucket's keys over all runs, in the order of each question; and the bucket's sums."""
    keys = [unpack_sorted(k) for k in asked["keys"].to_pylist()]
    ends = np.cumsum([0] + [len(k) for k in keys])
    counts = np.zeros((2, ends[-1]), np.uint64)
    for s, e, data in zip(ends, ends[1:], asked["counts"].to_pylist()):
        if data is not None:
            counts[:, s:e] = unpack(data, np.uint64).reshape(2, -1)
    distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
    totals = []
    for row in counts:
        by = np.zeros(len(distinct), np.uint64)
        np.add.at(by, places, row)
        totals.append(by)
    word = (distinct & _ONE) == _ONE
    bucket = asked["bucket"][0].as_py()
    sums = np.array([totals[0][word].sum(), totals[1][word].sum(), (totals[0][word] > 0).sum(),
                     ((totals[0] + totals[1])[word] > 0).sum()], np.uint64)
    data = [pack(np.concatenate([t[places[s:e]] for t in totals])) for s, e in zip(ends, ends[1:])]
    return pa.table({"run": pa.array([*asked["run"].to_pylist(), -1], pa.int32()),
                     "kind": pa.array([*asked["kind"].to_pylist(), _TOTALS], pa.int32()),
                     "bucket": pa.array([*asked["bucket"].to_pylist(), bucket], pa.int32()),
                     "data": pa.array([*data, sums.tobytes()], pa.binary())}, schema=_TELL)


def _told(info: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """2 x keys: totals without and of the deleted documents."""
    out = np.zeros((2, len(keys)), np.uint64)
    ends = cut(keys, buckets)
    for b, data in zip(info["bucket"].to_pylist(), info["data"].to_pylist()):
        out[:, ends[b]:ends[b + 1]] = unpack(data, np.uint64).reshape(2, -1)
    return out


def _context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two of its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int32)


def _shares(tokens: _Tokens, keys: np.ndarray, places: np.ndarray, totals: np.ndarray, n: float):
    """Per token: count, context count, bigram and unigram shares."""
    values = totals.astype(float)
    t = len(tokens.words)
    word, pair = values[places[:t]], values[places[t:2 * t]]
    context = tokens.contexts(word, values[places[2 * t]])
    return word, context, np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1)


def em_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = _ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per context bucket from histogram cells.

    A cell is (context bucket, bigram step, unigram step, tokens); step -1 is a share of 0.
    """
    weights = np.tile([1 / 3] * 3, (66, 1))
    if not cells:
        return weights
    c = np.array(cells, dtype=np.int64)
    p = np.stack([*(np.where(c[:, k] < 0, 0.0, 10.0 ** (-c[:, k] / _STEPS)) for k in (1, 2)),
                  np.full(len(c), uniform)], axis=1)
    n, bucket = c[:, 3].astype(float), c[:, 0]
    pooled = np.full(3, 1 / 3)
    for _ in range(rounds):
        post = p * pooled
        post /= post.sum(axis=1, keepdims=True)
        pooled = (post * n[:, None]).sum(axis=0) / n.sum()
    weights[:] = pooled  # buckets without deleted tokens, and the start for the others
    for _ in range(rounds):
        post = p * weights[bucket]
        post *= (n / post.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(bucket, post[:, k], 66) for k in range(3)], axis=1)
        weights = (mass + pooled) / (mass.sum(axis=1) + 1)[:, None]  # one token's worth of the pooled weights
    weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]  # an unseen context has no bigram share
    return weights


def score_lm(docs: DataFrame, learn: Column | None = None, delete: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text.

    ``learn`` selects the documents that are learned from (all), ``delete`` those of
    them whose counts are held out for the mixture weights (a tenth, by id hash).
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else learn
    delete = F.pmod(F.xxhash64(F.lit("deleted"), F.col(id_col)), F.lit(10)) == 0 if delete is None else delete
    role = F.when(~F.coalesce(learn, F.lit(False)), OTHER).when(F.coalesce(delete, F.lit(False)), DELETED).otherwise(
        COUNTED)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                         role.alias("_role"))
    runs = shared_sizes(narrow, "_text", run_bytes)
    dealt = narrow.withColumn("run", run_of("_id", runs))

    def ask(table: pa.Table) -> pa.Table:
        run, role = table["run"][0].as_py(), np.array(table["_role"].to_pylist())
        tokens = _Tokens(table["_text"].to_pylist())
        keys, places = tokens.distinct()
        t = len(tokens.words)
        of = role[tokens.owner]
        counts = []
        for r in (COUNTED, DELETED):
            on = of == r
            counts.append(np.bincount(np.concatenate([places[:t][on], places[t:2 * t][on]]),
                                      minlength=len(keys)).astype(np.uint64))
        rows = _question(run, _ALL_KEYS, keys, counts, runs)
        held = [x for x, r in zip(table["_text"].to_pylist(), role) if r == DELETED]
        if held:
            more = _question(run, _DELETED_KEYS, _Tokens(held).distinct()[0], None, runs)
            rows = {k: rows[k] + more[k] for k in rows}
        return pa.table({f.name: pa.array(rows[f.name], f.type) for f in _ASK}, schema=_ASK)

    told = materialize(dealt.groupBy("run").applyInArrow(ask, _ddl(_ASK))
                       .groupBy("bucket").applyInArrow(_answer, _ddl(_TELL)), "counts")
    release_shuffles(spark)
    # one row of four numbers per bucket
    sums = np.zeros(4)
    for row in told.where(F.col("kind") == _TOTALS).select("data").toLocalIterator():
        sums += np.frombuffer(row["data"], np.uint64).astype(float)
    counted, deleted, kinds_counted, kinds = sums

    def compare(table: pa.Table, info: pa.Table) -> pa.Table:
        tokens = _Tokens(table["_text"].to_pylist())
        keys, places = tokens.distinct()
        totals = _told(info, keys, runs)[0]
        _, context, p2, p1 = _shares(tokens, keys, places, totals, counted)
        step = [np.where(p > 0, np.round(-np.log10(np.maximum(p, 1e-300)) * _STEPS), -1).astype(np.int32)
                for p in (p2, p1)]
        cells, n = np.unique(np.stack([_context_bucket(context), *step], axis=1), axis=0, return_counts=True)
        return pa.table({"c": pa.array(cells[:, 0], pa.int32()), "b": pa.array(cells[:, 1], pa.int32()),
                         "u": pa.array(cells[:, 2], pa.int32()), "n": pa.array(n, pa.int64())})

    histogram = (dealt.where(F.col("_role") == DELETED).groupBy("run")
                 .cogroup(told.where(F.col("kind") == _DELETED_KEYS).groupBy("run"))
                 .applyInArrow(compare, "c int, b int, u int, n long")
                 .groupBy("c", "b", "u").agg(F.sum("n").alias("n")))
    weights = em_weights([tuple(r) for r in histogram.collect()], 1 / (kinds_counted + 1))
    release_shuffles(spark)
    total, uniform = counted + deleted, 1 / (kinds + 1)

    def score(table: pa.Table, info: pa.Table) -> pa.Table:
        tokens = _Tokens(table["_text"].to_pylist())
        keys, places = tokens.distinct()
        word, context, p2, p1 = _shares(tokens, keys, places, _told(info, keys, runs).sum(axis=0), total)
        w = weights[_context_bucket(context)]
        per_token = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * uniform)
        base = np.log10((word + 1) / (total + kinds + 1))
        sums = [np.add.reduceat(x, tokens.first) if len(tokens.first) else np.zeros(0)
                for x in (per_token, base, (word > 0).astype(np.int64))]
        return pa.table({"_id": table["_id"], "n_tokens": pa.array(tokens.lengths.astype(np.int64)),
                         "n_known": pa.array(sums[2], pa.int64()),
                         "train_tokens": pa.array(np.full(len(tokens.lengths), int(total)), pa.int64()),
                         "base_score": pa.array(sums[1], pa.float64()), "score": pa.array(sums[0], pa.float64())})

    kind = dict(docs.dtypes)[id_col]
    return (dealt.groupBy("run").cogroup(told.where(F.col("kind") == _ALL_KEYS).groupBy("run"))
            .applyInArrow(score, f"_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, "
                                 "score double").withColumnRenamed("_id", id_col))
