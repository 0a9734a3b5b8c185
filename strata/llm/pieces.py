"""SentencePiece encoding and decoding as a max-plus parallel scan.

Encoding is the best segmentation of a text into vocabulary pieces: the path of
the highest total score through the lattice of piece occurrences (blanks belong
to pieces, a dummy blank is put in front, characters outside the vocabulary are
spelled with byte pieces).  Literal U+2581 characters are not blanks here and are
spelled with bytes too, so decoding gives back every text exactly.

Texts of at most ``chunk_chars`` characters are encoded in one scan.  A longer
text is cut into chunks of that many characters, wherever the cut falls:

1. Every chunk yields a transfer matrix: entry (i, j) is the best score from
   lattice node i of the ``S`` nodes up to its left boundary to node j of the
   ``S`` nodes up to its right boundary (``S``: longest piece).  Max-plus matrix
   products combine chunks associatively.
2. A parallel scan over the matrices alone gives the score vector at every boundary:
   blocks of matrices are combined in a tree, and the vectors handed down it.
3. With its vector every chunk is backtraced on its own: for each exit node, the
   entry node it leads to and the pieces on the way (kept once where the paths
   agree, which is all but the last few pieces).
4. Per document the exit nodes are followed from the last chunk to the first and
   the pieces joined.

Shuffled are the chunks of long documents, their matrices and their pieces; a
task holds one chunk, one block of matrices, or the pieces of one document.

Scores are exact integers (a piece's score times 2^20, rounded) and ties go to the
longest last piece, so the result does not depend on where chunks are cut.  Scores
below -1e6 (a vocabulary's "never" marks) count as -1e6.

Defined results: null and empty texts have no pieces; repeated rows and rows
without an id are encoded one by one; an empty table gives an empty result; other
columns are kept only when named in ``carry``.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import give_back, materialize, slices, small_batches
from strata.llm.runs import mix, powers

MODEL = os.environ.get("STRATA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
CHUNK_CHARS = 65_536
#: neighbouring matrices (2 KB each) that one task of the scan combines
SCANNED = 64
_NEVER = -(1 << 62)
_LOWEST = -1_000_000.0
#: scores are kept as whole multiples of 1 / _UNIT
_UNIT = 1 << 20
#: a run of blanks and what follows it; no piece has a blank after another character
_SEGMENT = re.compile(r" *[^ ]+| +")
_CACHE_WORDS, _CACHE_CHARS, _BATCH_WORDS = 120_000, 48, 20_000
#: characters whose words are learned together
_TOGETHER = 1 << 20
#: below every sum over a cached word
_FAR = -(1 << 56)


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, read on the driver from a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


class _PieceTable:
    """Pieces by a 64-bit hash of their characters, in an open-addressed table."""

    _BITS = 18

    def __init__(self, ids: dict[str, int], score: dict[str, int]):
        pieces = list(ids)
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total, inverse = self._sums(chars)
        begins = np.cumsum(lengths) - lengths
        hashes = (total[begins + lengths] - total[begins]) * inverse[begins]
        if len(np.unique(hashes)) != len(pieces):
            raise ValueError("pieces collide")
        self.key = np.zeros(1 << self._BITS, np.uint64)
        self.id = np.full(1 << self._BITS, -1, np.int32)
        self.score = np.full(1 << self._BITS, _FAR, np.int64)
        for h, piece in zip(hashes.tolist(), pieces):
            slot = self._slot(h)
            while self.id[slot] >= 0:
                slot = (slot + 1) & ((1 << self._BITS) - 1)
            self.key[slot], self.id[slot], self.score[slot] = h, ids[piece], score[piece]

    def _slot(self, h):
        if isinstance(h, int):
            return (h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self._BITS)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._BITS)).astype(np.int64)

    @staticmethod
    def _sums(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = powers(len(chars) + 1)
        value = mix(chars.astype(np.uint64) + np.uint64(1)) * power[:len(chars)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)]), inverse

    def match(self, chars: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (-1: none) of the pieces of every length at every character of words of falling length."""
        ends = np.cumsum(lengths)
        n = len(chars)
        total, inverse = self._sums(chars)
        score = np.full((span, n), _FAR, np.int64)
        ids = np.full((span, n), -1, np.int32)
        for k in range(1, min(span, n) + 1):
            words = int(np.searchsorted(-lengths, -k, "right"))  # those of k characters or more
            if not words:
                break
            m = int(ends[words - 1]) - k + 1
            h = (total[k:m + k] - total[:m]) * inverse[:m]
            slot = self._slot(h)
            open_ = np.arange(m)
            while len(open_):
                at = slot[open_]
                full = self.id[at] >= 0
                hit = full & (self.key[at] == h[open_])
                where = open_[hit]
                score[k - 1, where], ids[k - 1, where] = self.score[at[hit]], self.id[at[hit]]
                open_ = open_[full & ~hit]
                slot[open_] = (slot[open_] + 1) & ((1 << self._BITS) - 1)
        return score, ids


def _text_of(bytes_of: list[bytes], ids: list[int]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids)).decode()[1:]


def spelled(vocabulary: list[tuple[str, float, int]]) -> list[bytes]:
    """The bytes of every piece, by id; all that decoding needs."""
    return [piece.replace("▁", " ").encode() if kind in (1, 4) else bytes([int(piece[3:5], 16)]) if kind == 6 else b""
            for piece, _, kind in vocabulary]


class Lattice:
    """The vocabulary as exact integer scores, and best paths through one text."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.score: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.bytes_of = spelled(vocabulary)
        byte_id = {}
        normal = [s for _, s, kind in vocabulary if kind in (1, 4)]
        lowest = max(_LOWEST, min(normal))
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind in (1, 4):
                text = piece.replace("▁", " ")
                if text.lstrip(" ").find(" ") >= 0:
                    raise ValueError(f"piece {piece!r} has a blank after another character")
                self.ids[text] = i
                self.score[text] = round(max(_LOWEST, score) * _UNIT)
            elif kind == 6:
                byte_id[int(piece[3:5], 16)] = i
        if len(byte_id) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_id = [byte_id[b] for b in range(256)]
        self.unknown = round((lowest - 10) * _UNIT)
        self.span = max(map(len, self.ids))
        # paths of recent words, and of those before them
        self._words: dict[str, tuple[int, bytes]] = {}
        self._old: dict[str, tuple[int, bytes]] = {}
        self._table = _PieceTable(self.ids, self.score)
        self._ascii = np.array(self.byte_id[:128], np.int32)

    def _edges(self, text: str, end: int, first: int):
        """(start, score) of every piece that ends at ``end`` and starts at or after ``first``."""
        score = self.score
        for start in range(max(first, end - self.span), end):
            s = score.get(text[start:end])
            if s is not None:
                yield start, s
        if text[end - 1] not in score:
            yield end - 1, self.unknown

    def forward(self, text: str, best: list[int], since: int) -> list[int]:
        """Extend ``best`` (scores of nodes 0..since) to every node; returns the predecessors."""
        back = [-1] * (since + 1)
        for end in range(since + 1, len(text) + 1):
            top, arg = _NEVER, -1
            for start, s in self._edges(text, end, 0):
                if best[start] > _NEVER and best[start] + s > top:
                    top, arg = best[start] + s, start
            best.append(top)
            back.append(arg)
        return back

    def spell(self, text: str, nodes: list[int]) -> bytes:
        """Ids (int32, native order) of the pieces between consecutive nodes."""
        out = []
        for a, b in zip(nodes, nodes[1:]):
            piece = text[a:b]
            i = self.ids.get(piece)
            out.extend([i] if i is not None else [self.byte_id[x] for x in piece.encode()])
        return np.array(out, np.int32).tobytes()

    @staticmethod
    def _trace(back: list[int], end: int, stop: int) -> list[int]:
        """Nodes of the best path to ``end``, from the last one at or before ``stop``."""
        nodes = [end]
        while nodes[-1] > stop:
            nodes.append(back[nodes[-1]])
        return nodes[::-1]

    def word(self, text: str) -> tuple[int, bytes]:
        """Score and ids of a text that is encoded by itself."""
        known = self._words.get(text)
        if known is None:
            best = [0]
            back = self.forward(text, best, 0)
            known = best[-1], self.spell(text, self._trace(back, len(text), 0))
            if len(text) <= _CACHE_CHARS:
                self._words[text] = known
        return known

    def forget(self) -> None:
        """Give the word caches up (at the end of a task: idle workers hold on to their memory)."""
        self._words, self._old = {}, {}

    def learn(self, words: set[str]) -> None:
        """Put the paths of ``words`` into the cache, a batch of them per array operation."""
        if len(self._words) > _CACHE_WORDS:
            self._old, self._words = self._words, {}
        new = []
        for w in words:
            if w not in self._words and len(w) <= _CACHE_CHARS:
                known = self._old.get(w)
                if known is None:
                    new.append(w)
                else:
                    self._words[w] = known
        new.sort(key=len, reverse=True)
        for at in range(0, len(new), _BATCH_WORDS):
            self._learn(new[at:at + _BATCH_WORDS])

    def _learn(self, words: list[str]) -> None:
        """Best paths of words in order of falling length: one step per end node and piece length."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        score, ids = self._table.match(chars, lengths, self.span)
        single = ids[0] < 0  # characters outside the vocabulary
        score[0][single] = self.unknown
        ids[0][single] = np.where(chars[single] < 128, self._ascii[np.minimum(chars[single], 127)], -1)
        longest = int(lengths[0])
        best = np.full((longest + 1, len(words)), _FAR, np.int64)
        best[0] = 0
        back = np.zeros((longest + 1, len(words)), np.int8)
        for t in range(1, longest + 1):
            live = int(np.searchsorted(-lengths, -t, "right"))
            top, arg, at = best[t, :live], back[t, :live], begins[:live] + t
            for k in range(min(self.span, t), 0, -1):  # longest piece first: it wins ties
                total = best[t - k, :live] + score[k - 1][at - k]
                better = total > top
                top[better] = total[better]
                arg[better] = k
        node, rows, found = lengths.copy(), np.arange(len(words)), []
        while len(rows):
            step = back[node[rows], rows]
            node[rows] -= step
            found.append((rows, ids[step - 1, begins[rows] + node[rows]]))
            rows = rows[node[rows] > 0]
        word = np.concatenate([r for r, _ in found])[::-1]
        piece = np.concatenate([i for _, i in found])[::-1]
        by = np.argsort(word, kind="stable")  # from the last piece back, reversed: first piece first
        piece, ends = piece[by].astype(np.int32), np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        spelled = set(np.unique(word[by][piece < 0]).tolist())  # their bytes are looked up one by one
        data, top, at = piece.tobytes(), best[lengths, np.arange(len(words))].tolist(), 0
        for i, w in enumerate(words):
            if i in spelled:
                self.word(w)
            else:
                self._words[w] = top[i], data[4 * at:4 * ends[i]]
            at = ends[i]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            segments, chars = [], 0
            while at < len(texts) and chars < _TOGETHER:
                segments.append(_SEGMENT.findall(" " + texts[at]) if texts[at] else [])
                chars += len(texts[at])
                at += 1
            self.learn(set(chain.from_iterable(segments)))
            words, fresh = self._words, self.word
            out.extend(b"".join([(words.get(w) or fresh(w))[1] for w in s]) for s in segments)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return _text_of(self.bytes_of, ids)

    # -- chunks: ``text`` is the chunk with ``lead`` characters of its left neighbour in front ----

    def _cuts(self, text: str, lead: int) -> tuple[int, int] | None:
        """First and last node after ``lead`` that every path crosses (before a blank that follows another character)."""
        first = next((m.start() + 1 for m in re.finditer(r"[^ ] ", text[max(0, lead - 1):])), None)
        if first is None:
            return None
        first += max(0, lead - 1)
        if first <= lead:
            later = re.search(r"[^ ] ", text[lead:])
            if later is None:
                return None
            first = lead + later.start() + 1
        last = len(text) - 1
        while not (text[last] == " " and text[last - 1] != " "):
            last -= 1
        return first, last

    def _from(self, text: str, lead: int, entry: int, until: int) -> tuple[list[int], list[int]]:
        """Best scores and predecessors of the nodes up to ``until`` for paths that leave node ``entry`` <= lead."""
        best = [_NEVER] * (lead + 1)
        best[entry] = 0
        back = self.forward(text[:until], best, lead)
        return best, back

    def transfer(self, text: str, lead: int) -> np.ndarray:
        """S x S max-plus matrix over the nodes up to the left and up to the right boundary."""
        s, n = self.span, len(text)
        out = np.full((s, s), _NEVER, np.int64)
        cuts = self._cuts(text, lead)
        if cuts is None:
            tails = None
        else:
            first, last = cuts
            words = _SEGMENT.findall(text[first:last])
            self.learn(set(words))
            middle = sum(self.word(w)[0] for w in words)
            tail = [0]
            self.forward(text[last:], tail, 0)
            tails = [middle + tail[p - last] if p >= last and tail[p - last] > _NEVER else None
                     for p in range(n - s + 1, n + 1)]
        for i in range(s):
            entry = lead - s + 1 + i
            if entry < 0:
                continue
            if tails is None:
                best, _ = self._from(text, lead, entry, n)
                for j, p in enumerate(range(n - s + 1, n + 1)):
                    if p >= 0 and best[p] > _NEVER:
                        out[i, j] = best[p]
            else:
                best, _ = self._from(text, lead, entry, cuts[0])
                if best[cuts[0]] > _NEVER:
                    for j, t in enumerate(tails):
                        if t is not None:
                            out[i, j] = best[cuts[0]] + t
        return out

    def paths(self, text: str, lead: int, vector: list[int]) -> tuple[list[int], bytes, list[bytes]]:
        """For every exit state: its entry state (-1: unreachable) and its ids after the common ones."""
        s, n = self.span, len(text)
        offset = lead - s + 1  # node of entry state 0
        best = [vector[p - offset] if p >= offset else _NEVER for p in range(lead + 1)]
        leaves = range(n - s + 1, n + 1)
        cuts = self._cuts(text, lead)
        if cuts is None:
            back = self.forward(text, best, lead)
            traces = [self._trace(back, p, lead) if p > lead and best[p] > _NEVER else None for p in leaves]
            # a chunk shorter than a state window: its left context is part of the exit window
            traces = [t if t or not (max(0, offset) <= p <= lead and best[p] > _NEVER) else [p]
                      for t, p in zip(traces, leaves)]
            found = [t for t in traces if t]
            same = 0
            while found and all(same < len(t) and t[same] == found[0][same] for t in found):
                same += 1
            same = max(0, same - 1)
            common = self.spell(text, found[0][:same + 1]) if found and same else b""
            return ([t[0] - offset if t else -1 for t in traces], common,
                    [self.spell(text, t[same:]) if t else b"" for t in traces])
        first, last = cuts
        back = self.forward(text[:first], best, lead)
        nodes = self._trace(back, first, lead)
        words = _SEGMENT.findall(text[first:last])
        self.learn(set(words))
        common = self.spell(text, nodes) + b"".join([self.word(w)[1] for w in words])
        tail = [0]
        back = self.forward(text[last:], tail, 0)
        reach = [p >= last and tail[p - last] > _NEVER for p in leaves]
        return ([nodes[0] - offset if ok else -1 for ok in reach], common,
                [self.spell(text[last:], self._trace(back, p - last, 0)) if ok else b"" for p, ok in zip(leaves, reach)])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices (associative); unreachable stays unreachable."""
    total = a[:, :, None] + np.maximum(b[None], _NEVER >> 1)
    total = np.where((a[:, :, None] <= _NEVER >> 1) | (b[None] <= _NEVER >> 1), _NEVER, total)
    return total.max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of neighbouring chunks together, combined pairwise as a tree."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i:i + 2]) if i + 1 < len(matrices) else matrices[i]
                    for i in range(0, len(matrices), 2)]
    return matrices[0]


def boundary_vectors(matrices: list[np.ndarray], span: int, before: np.ndarray | None = None) -> list[np.ndarray]:
    """Scores of the nodes up to every left boundary, relative to the best of them.

    ``before`` are those of the first boundary (None: the front of the text).
    """
    if before is None:
        before = np.full(span, _NEVER, np.int64)
        before[span - 1] = 0  # the node in front of the text
    vector = before.reshape(1, span)
    out = [vector[0]]
    for m in matrices[:-1]:
        vector = combine(vector, m)
        vector = np.where(vector <= _NEVER >> 1, _NEVER, vector - vector.max())
        out.append(vector[0])
    return out


def join_paths(entries: list[list[int]], common: list[bytes], tails: list[list[bytes]], span: int) -> bytes:
    """Ids of a text from the paths of its chunks, followed back from the node behind the text."""
    out, leave = [], span - 1
    for entry, shared, tail in zip(reversed(entries), reversed(common), reversed(tails)):
        out.append(shared + tail[leave])
        leave = entry[leave]
    return b"".join(reversed(out))


_LATTICE: dict[int, Lattice] = {}


def _lattice(shared) -> Lattice:
    """One per Python worker, so the word cache serves all its tasks."""
    if shared.id not in _LATTICE:
        _LATTICE.clear()
        _LATTICE[shared.id] = Lattice(shared.value)
    return _LATTICE[shared.id]


class _Shared:
    def __init__(self, spark, vocabulary):
        self._b, self.id = spark.sparkContext.broadcast(vocabulary), zlib.crc32(repr(vocabulary[-50:]).encode())

    @property
    def value(self):
        return self._b.value


def _scan(moved: DataFrame, most: int, span: int) -> DataFrame:
    """_key, _chunk, _vector: the vectors at every left boundary, from the matrices of the chunks.

    A parallel prefix scan: the matrices of ``SCANNED`` neighbouring chunks are combined into
    one, and these again, until ``most`` chunks of a text have become a single one; then the
    vectors are handed down the same tree, each block continuing from that at its own start.
    """
    def of(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(m, np.int64).reshape(span, span) for m in pdf.sort_values("_chunk")["_matrix"]]

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1].to_numpy(), "_chunk": pdf["_block"].iloc[:1].to_numpy(),
                             "_matrix": [product(of(pdf)).tobytes()]})

    def down(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        before = np.frombuffer(start["_vector"].iloc[0], np.int64) if len(start) else None
        return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "_chunk": np.sort(pdf["_chunk"].to_numpy()),
                             "_vector": [v.tobytes() for v in boundary_vectors(of(pdf), span, before)]})

    def blocks(df: DataFrame) -> DataFrame:
        return df.withColumn("_block", F.floor(F.col("_chunk") / SCANNED).cast("int"))

    levels = [moved]
    while most > SCANNED:
        levels.append(materialize(blocks(levels[-1]).groupBy("_key", "_block")
                                  .applyInPandas(up, "_key long, _chunk int, _matrix binary"), "matrices"))
        most = -(-most // SCANNED)
    schema = "_key long, _chunk int, _vector binary"
    top = levels.pop()
    vectors = top.groupBy("_key").applyInPandas(lambda pdf: down(pdf, pdf.iloc[:0]), schema)
    for level in reversed(levels):
        starts = vectors.withColumnRenamed("_chunk", "_block")
        vectors = (blocks(level).groupBy("_key", "_block").cogroup(starts.groupBy("_key", "_block"))
                   .applyInPandas(down, schema))
    return vectors


def _again(lattice: Lattice, ids: bytes) -> str:
    """The text that encoded ids (int32, native order) decode to."""
    return lattice.decode(np.frombuffer(ids, np.int32).tolist()) if ids else ""


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, vocabulary: list[tuple[str, float, int]], id_col: str = "doc_id",
           text_col: str = "text", carry: tuple[str, ...] = (), chunk_chars: int = CHUNK_CHARS,
           decoded: str | None = None) -> DataFrame:
    """id, the columns in ``carry``, and ``ids`` (array of piece ids) of every whole text.

    ``decoded`` names a column for the text that the ids decode to, made by the worker that
    made them (``decode`` would start a second worker per task).
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = _Shared(spark, vocabulary)
    span = Lattice(vocabulary).span
    if chunk_chars < span:
        raise ValueError(f"chunk_chars must be at least {span}")
    out_cols = [id_col, *[c for c in carry if c != id_col]]
    if "ids" in out_cols or decoded in [*out_cols, "ids"]:
        raise ValueError("a carried column is named like a result")
    # the id and the carried columns travel as one struct, so their names meet no other
    narrow = docs.select(F.struct(*out_cols).alias("_row"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kept = ["_row"]
    cols = f"_row {narrow.schema['_row'].dataType.simpleString()}"
    is_long = F.char_length("_text") > chunk_chars

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in chain.from_iterable(slices(b, len(kept)) for b in batches):
            out = lattice.encode_all(batch.column(len(kept)).to_pylist())
            back = [] if decoded is None else [pa.array([_again(lattice, ids) for ids in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], _lists(out), *back],
                                             [*kept, "ids", "_decoded"][:len(kept) + 1 + len(back)])
        lattice.forget()
        give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = " " + batch.column(len(kept))[r].as_py()
                for k, at in enumerate(range(0, len(text), chunk_chars)):
                    lead = min(at, span - 1)
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(r, 1) for c in batch.columns[:len(kept)]), batch.column(len(kept) + 1).slice(r, 1),
                         pa.array([k], pa.int32()), pa.array([lead], pa.int32()),
                         pa.array([text[at - lead:at + chunk_chars]], pa.string())],
                        [*kept, "_key", "_chunk", "_lead", "_part"])

    made = "ids array<int>" + (", _decoded string" if decoded is not None else "")
    whole = narrow.where(~is_long).mapInArrow(short, f"{cols}, {made}")
    chunks = materialize(narrow.where(is_long).withColumn("_key", F.monotonically_increasing_id())
                         .mapInArrow(cut, f"{cols}, _key long, _chunk int, _lead int, _part string"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            key, chunk, lead, part = batch.columns
            out = [lattice.transfer(t, n).tobytes() for t, n in zip(part.to_pylist(), lead.to_pylist())]
            yield pa.RecordBatch.from_arrays([key, chunk, pa.array(out, pa.binary())], ["_key", "_chunk", "_matrix"])
        lattice.forget()
        give_back()

    moved = materialize(chunks.select("_key", "_chunk", "_lead", "_part").mapInArrow(
        matrices, "_key long, _chunk int, _matrix binary"), "matrices")
    vectors = _scan(moved, (chunks.agg(F.max("_chunk")).first()[0] or 0) + 1, span)

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            key, chunk, lead, part, vector = batch.columns
            out = [lattice.paths(t, n, np.frombuffer(v, np.int64).tolist())
                   for t, n, v in zip(part.to_pylist(), lead.to_pylist(), vector.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [key, chunk, pa.array([e for e, _, _ in out], pa.list_(pa.int32())),
                 pa.array([c for _, c, _ in out], pa.binary()),
                 pa.array([t for _, _, t in out], pa.list_(pa.binary()))],
                ["_key", "_chunk", "_entries", "_common", "_tails"])
        lattice.forget()
        give_back()

    traced = (chunks.select("_key", "_chunk", "_lead", "_part").join(vectors, ["_key", "_chunk"])
              .mapInArrow(backtrace, "_key long, _chunk int, _entries array<int>, _common binary, "
                                     "_tails array<binary>"))

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        ids = join_paths([list(e) for e in pdf["_entries"]], list(pdf["_common"]), [list(t) for t in pdf["_tails"]], span)
        out = pd.DataFrame({"_key": pdf["_key"].iloc[:1].to_numpy(), "ids": [np.frombuffer(ids, np.int32)]})
        return out if decoded is None else out.assign(_decoded=[_again(_lattice(shared), ids)])

    joined = (traced.groupBy("_key").applyInPandas(assemble, f"_key long, {made}")
              .join(chunks.where("_chunk = 0").select(*kept, F.col("_key")), "_key").drop("_key"))
    out = whole.unionByName(joined)
    return out.select("_row.*", "ids", *([] if decoded is None else [F.col("_decoded").alias(decoded)]))


def decode(encoded: DataFrame, vocabulary: list[tuple[str, float, int]], ids_col: str = "ids",
           text_col: str = "text") -> DataFrame:
    """All columns of ``encoded`` and the decoded text."""
    shared = encoded.sparkSession.sparkContext.broadcast(spelled(vocabulary))
    others = encoded.columns
    at = others.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value
        for batch in chain.from_iterable(slices(b, at) for b in batches):
            lists = batch.column(at)
            ends, values = lists.offsets.to_pylist(), lists.values.to_numpy()
            texts = [_text_of(bytes_of, values[a:b].tolist()) if b > a else "" for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*others, text_col])
        give_back()

    schema = ", ".join(f"`{c}` {k}" for c, k in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, `{text_col}` string")
