"""Text expressions (Unicode-aware whitespace, code-point lengths)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex \s is ASCII-only; (?U) makes it match Unicode spaces as Python does.
WS = r"(?U)\s+"


def clean_text(c: Column) -> Column:
    """null → '', lower case, trim Unicode whitespace, collapse inner runs to one space."""
    s = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    s = F.regexp_replace(s, r"(?U)^\s+", "")
    s = F.regexp_replace(s, r"(?U)\s+$", "")
    return F.regexp_replace(s, WS, " ")


def text_length(c: Column) -> Column:
    """Length in code points (an emoji counts 1)."""
    return F.length(c)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words; '' → 0."""
    return F.size(F.filter(F.split(c, WS), lambda w: w != F.lit("")))
