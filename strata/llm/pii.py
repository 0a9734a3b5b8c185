"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

Values are found by shape and then *validated* (Luhn for card numbers, mod 97 for
IBANs, octet ranges for IPv4, area and exchange rules for phone and social
security numbers, the calendar for dates); what fails validation is left alone.
Where a span has several readings they are tried in turn: card numbers from the
longest to the shortest that end with a group of digits, IBANs first at the length
of their country.  After a start with no valid reading the search goes on right
behind that start, so a valid value beside other digits or capitals is found; only
an IBAN with its country's length and wrong check digits is passed over whole, since
its digits are no card number.
Every valid value is replaced by another valid value of the same format: its
free digits or letters are read as one number of a domain of known size, and a
balanced Feistel network keyed with ``key`` permutes that domain.  Values of the
domain that would not be valid are walked past (cycle walking), so the map is a
bijection on valid values: equal values stay equal in every document, different
values stay different.  ``back`` inverts it with the key, wherever the
masked text is read at the same places as the original: with further digits directly
beside a card number, a longer or earlier reading that failed on the original can
pass the Luhn check by chance on the masked digits (one in ten each).

The work is a scan (no shuffle); texts without a digit or ``@`` are passed on.
Memory per task is one Arrow batch.

Defined results: null text stays null with zero counts; empty texts stay empty;
whole texts are read whatever their length (every pattern is bounded, so time is
linear); repeated rows give the same result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from datetime import date, timedelta
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices

ROUNDS = 10
KINDS = ("email", "iban", "ip", "date", "phone", "ssn", "card")

_SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})"
            r"(?:(?=[Tt]\d{2}:?\d{2})|(?![\w/-]|\.\d))",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![A-Za-z0-9])(?:\d[ -]?){12,18}\d(?![A-Za-z0-9])",
}
_FIND = re.compile("|".join(f"(?P<{kind}>{shape})" for kind, shape in _SHAPES.items()))
_AT = {kind: re.compile(shape) for kind, shape in _SHAPES.items()}

#: length of an IBAN by country (ISO 13616 registry)
_IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}.items() for country in countries.split()}
_IBAN_OF = {n: re.compile(r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){%d}%s(?![A-Za-z0-9])"
                          % ((n - 4) // 4, r"[ ]?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")) for n in range(15, 35)}

FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Feistel:
    """A keyed permutation of range(size) for any size, and its inverse."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tweak: bytes, i: int, half: int, mod: int) -> int:
        data = b"%s|%d|%d" % (tweak, i, half)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24).digest(), "big") % mod

    def _once(self, n: int, side: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(n, side)
        if back:
            for i in reversed(range(self.rounds)):
                left, right = (right - self._round(tweak, i, left, side)) % side, left
        else:
            for i in range(self.rounds):
                left, right = right, (left + self._round(tweak, i, right, side)) % side
        return left * side + right

    def permute(self, n: int, size: int, tweak: bytes, back: bool = False, valid=None) -> int:
        """The image of ``n``; walks past numbers outside the domain or not ``valid``."""
        side = math.isqrt(size - 1) + 1
        while True:
            n = self._once(n, side, tweak, back)
            if n < size and (valid is None or valid(n)):
                return n


def luhn_digit(payload: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(payload)):
        d = int(ch)
        if i % 2 == 0:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(ch for ch in text if ch.isdigit())


def _lay(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if ch.isdigit() else ch for ch in shape)


def _card(value: str, f: Feistel, back: bool) -> str | None:
    d = _digits(value)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = f.permute(int(d[:-1]), 10 ** (len(d) - 1), b"card%d" % len(d), back,
                  lambda x: len(set((p := f"{x:0{len(d) - 1}d}") + luhn_digit(p))) > 1)
    payload = f"{n:0{len(d) - 1}d}"
    return _lay(value, payload + luhn_digit(payload))


def _phone(value: str, f: Feistel, back: bool) -> str | None:
    d = _digits(value)
    prefix, d = d[:-10], d[-10:]
    ok = lambda x: f"{x:010d}"[0] in "23456789" and f"{x:010d}"[3] in "23456789"
    if not ok(int(d)):
        return None
    return _lay(value, prefix + f"{f.permute(int(d), 10 ** 10, b'phone', back, ok):010d}")


def _ssn(value: str, f: Feistel, back: bool) -> str | None:
    def ok(x: int) -> bool:
        s = f"{x:09d}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    d = _digits(value)
    return _lay(value, f"{f.permute(int(d), 10 ** 9, b'ssn', back, ok):09d}") if ok(int(d)) else None


def _ip(value: str, f: Feistel, back: bool) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    n = f.permute(int.from_bytes(bytes(map(int, octets)), "big"), 2 ** 32, b"ip", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(value: str, f: Feistel, back: bool) -> str | None:
    sep = next(ch for ch in value if not ch.isdigit())
    parts = value.split(sep)
    year_first = len(parts[0]) == 4

    def read(a: str, b: str, c: str):
        try:
            return date(int(a), int(b), int(c))
        except ValueError:
            return None

    if year_first:
        day, order, ok = read(*parts), "ymd", None
    elif sep == "/" and (day := read(parts[2], parts[0], parts[1])):
        order, ok = "mdy", None
    else:
        day, order = read(parts[2], parts[1], parts[0]), "dmy"
        # with slashes only a day beyond 12 tells day-first from month-first
        ok = (lambda x: (FIRST_DAY + timedelta(x)).day > 12) if sep == "/" else None
    if day is None or not FIRST_DAY <= day <= LAST_DAY:
        return None
    n = f.permute((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, b"date", back, ok)
    new = FIRST_DAY + timedelta(n)
    wide = 2 if all(len(p) >= 2 for p in parts) else 1
    text = {"y": str(new.year), "m": f"{new.month:0{wide}d}", "d": f"{new.day:0{wide}d}"}
    return sep.join(text[p] for p in order)


def _classes(text: str):
    """Position, size and first character of every free letter or digit."""
    for i, ch in enumerate(text):
        if "0" <= ch <= "9":
            yield i, 10, "0"
        elif "a" <= ch <= "z":
            yield i, 26, "a"
        elif "A" <= ch <= "Z":
            yield i, 26, "A"


def _same_shape(text: str, f: Feistel, tweak: bytes, back: bool) -> str:
    """Permute letters among letters of the same case and digits among digits."""
    free = list(_classes(text))
    size = n = 0
    size = math.prod(k for _, k, _ in free)
    for i, k, first in free:
        n = n * k + ord(text[i]) - ord(first)
    if size < 2:
        return text
    shape = "".join({"0": "9", "a": "a", "A": "A"}[first] for _, _, first in free)
    n = f.permute(n, size, tweak + shape.encode(), back)
    out = list(text)
    for i, k, first in reversed(free):
        n, r = divmod(n, k)
        out[i] = chr(ord(first) + r)
    return "".join(out)


def _email(value: str, f: Feistel, back: bool) -> str | None:
    local, _, domain = value.partition("@")
    if domain.endswith("-") or "-." in domain or ".-" in domain or not re.search(r"\.[A-Za-z]{2,}$", domain):
        return None
    return _same_shape(local, f, b"email", back) + "@" + domain


def _iban(value: str, f: Feistel, back: bool) -> str | None:
    compact = value.replace(" ", "")
    number = lambda s: int("".join(str(int(ch, 36)) for ch in s))
    if not 15 <= len(compact) <= 34 or number(compact[4:] + compact[:4]) % 97 != 1:
        return None
    account = _same_shape(compact[4:], f, b"iban", back)
    check = f"{98 - number(account + compact[:2] + '00') % 97:02d}"
    it = iter(compact[:2] + check + account)
    return "".join(ch if ch == " " else next(it) for ch in value)


_REPLACE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def _readings(kind: str, m: re.Match) -> Iterator[str]:
    """The values that the span of ``m`` can begin with, in the order in which they are tried."""
    value = m[0]
    if kind == "card":
        digits, ends = 0, []
        for i, ch in enumerate(value):
            digits += ch.isdigit()
            if digits >= 13 and ch.isdigit() and not value[i + 1:i + 2].isdigit():
                ends.append(i + 1)
        yield from (value[:end] for end in reversed(ends))
    elif kind == "iban":
        own = _IBAN_LENGTH.get(value[:2])
        for n in [own] if own else range(34, 14, -1):
            if shorter := _IBAN_OF[n].match(m.string, m.start()):
                yield shorter[0]
        if own:
            yield value
    else:
        yield value


def pseudonymize(text: str, feistel: Feistel, counts: dict | None = None, back: bool = False) -> str:
    """``text`` with every validated value replaced (``back``: by its original)."""
    def replaced(found: re.Match) -> tuple[str, str, str] | None:
        """Kind, value and replacement of the first valid reading at the start of ``found``."""
        first = next(i for i, k in enumerate(KINDS) if found[k] is not None)
        for kind in KINDS[first:]:
            m = found if kind == KINDS[first] else _AT[kind].match(text, found.start())
            for value in _readings(kind, m) if m else ():
                if (new := _REPLACE[kind](value, feistel, back)) is not None:
                    return kind, value, new
        return None

    out, done, at = [], 0, 0
    while found := _FIND.search(text, at):
        start = found.start()
        if (swap := replaced(found)) is None:
            own = found["iban"] and _IBAN_OF.get(_IBAN_LENGTH.get(found["iban"][:2]))
            wrong = own.match(text, start) if own else None
            at = wrong.end() if wrong else start + 1
            continue
        kind, value, new = swap
        out += text[done:start], new
        done = at = start + len(value)
        if counts is not None:
            counts[kind] += 1
    return "".join([*out, text[done:]])


_MAY_HOLD = re.compile(r"[0-9@]")


def mask_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with pseudonyms, n_found and one count per kind."""
    cols = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in chain.from_iterable(slices(b, 1) for b in batches):
            ids, texts = batch.columns
            out, counted = [], []
            for text in texts.to_pylist():
                counts = dict.fromkeys(KINDS, 0)
                if text and _MAY_HOLD.search(text):
                    text = pseudonymize(text, feistel, counts)
                out.append(text)
                counted.append(counts)
            columns = [ids, pa.array(out, pa.string()),
                       pa.array([sum(c.values()) for c in counted], pa.int64()),
                       *(pa.array([c[k] for c in counted], pa.int64()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, text_col, "n_found", *cols])

    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"`{id_col}` {kind}", f"`{text_col}` string", "n_found long", *(f"{c} long" for c in cols)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
