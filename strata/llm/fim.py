"""Fill-in-middle transformation by content-defined chunk memoization.

A text of n tokens (runs of ASCII letters, and every other character on its own) is
cut behind two token counts into prefix, middle and suffix, which are written with
sentinels in the order of a form: ``psm``, ``spm``, or the text itself as ``plain``.

Cutting needs the number of tokens of the whole text, and then the place of two of
them.  Both come from chunks:

1. A rolling (gear) hash over the last 16 bytes cuts the bytes of a text where the
   hash's top bits are zero, so equal passages get equal chunks wherever they stand.
2. A chunk's *boundary summary* is the number of tokens that start in it, its number
   of characters, and whether its first and last byte are letters.  Summaries are
   kept per task in a cache whose key is the chunk's content itself: a hit is a
   comparison of bytes, not of hashes.
3. Summaries combine: a chunk that begins with a letter behind one that ends with a
   letter starts one token less.  Running counts name the chunk in which a cut lies,
   and only that chunk is read for the place.

The hashes that choose cuts and form are Spark columns; the rest is one
``mapInArrow`` without a shuffle.  A worker holds a slice of about 1 MB of text (more
if one text is longer) and a cache of at most ``2 * CACHE_BYTES`` of chunks.

Defined results: a null text counts as empty, and an empty one is plain with no
tokens; a null id is hashed like an empty one; rows that share an id are cut by the
same hashes, each in its own text; a text that holds a sentinel is plain, so every
output can be taken apart again; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import give_back, slices, small_batches

#: sentinels of the forms (fixed values)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: percent of texts that are transformed, and percent of these in form spm (fixed values)
RATE, SPM = 90, 20

#: chunks end where the hash's top ``CUT_BITS`` bits are zero, and hold ``SHORTEST`` to ``LONGEST`` bytes
CUT_BITS, SHORTEST, LONGEST = 8, 64, 4096
#: bytes of chunks in one generation of a task's cache
CACHE_BYTES = 16 << 20

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_INNER = bytes(range(0x80, 0xC0))  # bytes inside a character
#: letters stay, other bytes become blanks
_MASK = bytes(b if b in _LETTERS else 32 for b in range(256))
_TOKEN = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF]")
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions behind which the rolling hash over the last 16 bytes allows a chunk to end."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes, older bytes shifted further
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h < np.uint32(1 << 32 - CUT_BITS)) + 1


def chunk_ends(points: list[int], begin: int, end: int) -> Iterator[int]:
    """Ends of the chunks of the text ``begin:end``, given the allowed points inside it."""
    at = begin
    for p in points:
        while p - at > LONGEST:
            at += LONGEST
            yield at
        if p - at >= SHORTEST:
            at = p
            yield at
    while end - at > LONGEST:
        at += LONGEST
        yield at
    if end > at:
        yield end


def summarize(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Tokens that start in ``chunk``, its characters, and whether it begins and ends with a letter."""
    shape = chunk.translate(_MASK, _INNER)
    return shape.count(b" ") + len(shape.split()), len(shape), chunk[0] in _LETTERS, chunk[-1] in _LETTERS


class Summaries:
    """Boundary summaries by chunk content, in two generations of ``size`` bytes each."""

    def __init__(self, size: int = CACHE_BYTES):
        self.size, self.held = size, 0
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or summarize(chunk)
            if self.held > self.size:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk) + 150
        return found


class Cuts:
    """Token count of one text and the places of its tokens, from the summaries of its chunks."""

    def __init__(self, text: bytes, ends: list[int], cache: Summaries):
        self.text, self.ends = text, [0, *ends]
        tokens, chars, carry = [0], [0], False
        self.carry = []  # whether the letter run before a chunk goes on in it
        for a, b in zip(self.ends, ends):
            n, c, first, last = cache.of(text[a:b])
            self.carry.append(carry and first)
            tokens.append(tokens[-1] + n - (carry and first))
            chars.append(chars[-1] + c)
            carry = last
        self.tokens, self.chars = tokens, chars

    @property
    def n(self) -> int:
        return self.tokens[-1]

    def behind(self, k: int) -> tuple[int, int]:
        """Byte and character at which the first ``k`` tokens end."""
        if k >= self.n:
            return len(self.text), self.chars[-1]
        j = int(np.searchsorted(self.tokens, k, "right")) - 1  # the chunk in which token k starts
        a = self.ends[j]
        chunk = self.text[a:self.ends[j + 1]]
        at = next(islice(_TOKEN.finditer(chunk), k - self.tokens[j] + self.carry[j], None)).start()
        return a + at, self.chars[j] + len(chunk[:at].translate(None, _INNER))


_SCHEMA = "_id {}, n_tokens long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   rate: int = RATE, spm: int = SPM) -> DataFrame:
    """id, n_tokens, form, prefix_chars, middle_chars (characters, null if plain), output per row.

    Of the four unsigned numbers in the first 32 hex digits of sha256("seed:id"), the first
    two, modulo n + 1, give the cuts; the third makes ``rate`` percent of the texts
    transformed and the fourth ``spm`` percent of these of form spm.
    """
    small_batches(docs.sparkSession)
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)

    def number(k: int) -> Column:
        return F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = ((text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX))
             | F.contains(text, F.lit(MIDDLE)) | (number(2) % 100 >= rate))
    rows = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), number(0).alias("_a"), number(1).alias("_b"),
        F.when(plain, "plain").when(number(3) % 100 < spm, "spm").otherwise("psm").alias("_form"))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches):
        cache = Summaries()
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).cast(pa.large_binary()).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                points = cut_points(data) if len(data) else np.zeros(0, np.int64)
                stops = np.cumsum([len(t) for t in texts])
                bounds = np.searchsorted(points, [0, *stops.tolist()], "right").tolist()
                counts, prefixes, middles, outputs = [], [], [], []
                for k, (text, a, b, form) in enumerate(zip(texts, *(batch.column(i).to_pylist() for i in (2, 3, 4)))):
                    begin = int(stops[k]) - len(text)
                    inside = (points[bounds[k]:bounds[k + 1]] - begin).tolist()
                    cuts = Cuts(text, list(chunk_ends(inside, 0, len(text))), cache)
                    counts.append(cuts.n)
                    if form == "plain":
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(text)
                        continue
                    first, second = sorted((a % (cuts.n + 1), b % (cuts.n + 1)))
                    (x, left), (y, right) = cuts.behind(first), cuts.behind(second)
                    prefixes.append(left)
                    middles.append(right - left)
                    parts = ((s, text[y:], p, text[:x], m, text[x:y]) if form == "spm"
                             else (p, text[:x], s, text[y:], m, text[x:y]))
                    outputs.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), batch.column(4), pa.array(prefixes, pa.int64()),
                     pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                    ["_id", "n_tokens", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, _SCHEMA.format(kind)).withColumnRenamed("_id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form: the parts between the sentinels, back in order."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
