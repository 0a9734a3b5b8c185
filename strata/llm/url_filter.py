"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Every rule is a glob over the canonical URL ``.host/path`` (host lower-cased,
query and fragment cut off, a dot in front so that ``*.org`` covers ``org`` and
all its subdomains).  ``*`` in the host part stops at ``/``; in the path part it
matches anything; ``?`` matches one byte.  All globs are packed one after
another into one bit vector of 64-bit words (multiword Shift-And): per byte of
a URL one shift, one AND with the byte's mask and one AND with the self-loop
mask move all patterns at once.  The automaton runs over a whole Arrow batch of
URLs together, one byte position per step.

The work is a scan (no shuffle); memory is one batch times the number of words.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is blocked by the default; repeated rows are judged alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import UPPER


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return "*." + self.host, self.path + "*"


#: globs (host part, path part) that are blocked where no rule fits
BLOCK_GLOBS = (
    ("*.casino*", "*"), ("*.adult.*", "*"), ("*.ads.*", "*"), ("*.tracker.*", "*"),
    ("*", "/login*"), ("*", "*/wp-admin/*"), ("*", "*/cart/*"),
    ("*", "*.exe"), ("*", "*.zip"), ("*", "*.jpg"), ("*", "*.png"),
)


def _elements(host_glob: str, path_glob: str):
    """(byte class or None for a star, class) in pattern order."""
    everything = np.ones(256, bool)
    in_host = everything.copy()
    in_host[ord("/")] = False
    for glob, any_byte in ((host_glob, in_host), (path_glob, everything)):
        for b in glob.encode():
            if b == ord("*"):
                yield True, any_byte
            elif b == ord("?"):
                yield False, any_byte
            else:
                yield False, np.arange(256) == b


class GlobAutomaton:
    """All globs packed into ``words`` 64-bit words; bit i of pattern p is state i."""

    def __init__(self, globs: list[tuple[str, str]]):
        states = []  # per state: (enter class or None for a start state, self-loop class)
        starts, finals = [], []
        for host, path in globs:
            starts.append(len(states))
            states.append([None, np.zeros(256, bool)])
            for star, cls in _elements(host, path):
                if star:
                    states[-1][1] = states[-1][1] | cls
                else:
                    states.append([cls, np.zeros(256, bool)])
            finals.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.finals = finals
        for i, (cls, loop) in enumerate(states):
            word, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
            if cls is not None:
                self.enter[cls, word] |= bit
            self.loop[loop, word] |= bit
        for i in starts:
            self.start[i // 64] |= np.uint64(1) << np.uint64(i % 64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: urls x globs."""
        n = len(urls)
        lengths = np.fromiter((len(u) for u in urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")  # the active urls are then a prefix
        flat = np.frombuffer(b"".join(urls), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if n else np.zeros(0, np.int64)
        ordered = lengths[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        active = n
        for at in range(int(ordered[0]) if n else 0):
            while ordered[active - 1] <= at:
                active -= 1
            byte = flat[begin[:active] + at]
            live = state[:active]
            moved = live << one
            moved[:, 1:] |= live[:, :-1] >> top
            state[:active] = (moved & self.enter[byte]) | (live & self.loop[byte])
        out = np.zeros((n, len(self.finals)), bool)
        for k, i in enumerate(self.finals):
            out[order, k] = (state[:, i // 64] >> np.uint64(i % 64)) & one != 0
        return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(hosts: list[str], paths: list[str], rules: tuple[UrlRule, ...],
          block_globs=BLOCK_GLOBS) -> tuple[list[str | None], list[str]]:
    """The longest rule that fits each URL and the verdict."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = GlobAutomaton([r.globs for r in ranked] + list(block_globs))
    urls = [f".{h}{p}".encode() if h or p else b"" for h, p in zip(hosts, paths)]
    fits = automaton.match(urls)
    by_rule, by_glob = fits[:, :len(ranked)], fits[:, len(ranked):].any(axis=1)
    has_rule = by_rule.any(axis=1)
    first = by_rule.argmax(axis=1) if len(ranked) else np.zeros(len(urls), int)
    names, verdicts = [], []
    for i, url in enumerate(urls):
        rule = ranked[first[i]] if has_rule[i] else None
        names.append(rule.name if rule else None)
        verdicts.append(rule.verdict if rule else "block" if by_glob[i] or not url else "allow")
    return names, verdicts


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...], id_col: str = "page_id",
                url_col: str = "url", block_globs=BLOCK_GLOBS) -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``."""
    parts = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"),
                         path_of(F.col(url_col)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, paths = batch.columns
            names, verdicts = judge(hosts.to_pylist(), paths.to_pylist(), rules, block_globs)
            yield pa.RecordBatch.from_arrays(
                [ids, hosts, paths, pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                [id_col, "host", "path", "rule", "verdict"])

    kind = dict(parts.dtypes)[id_col]
    return parts.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
