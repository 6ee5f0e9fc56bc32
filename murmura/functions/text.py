"""Tokens of a text.

Only U+0020 separates tokens.  Leading and inner empty tokens count, trailing
ones do not, and a text without any character above U+0020 has no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters up to U+0020 make a text blank and are trimmed.
VISIBLE = r"[^\x00-\x20]"
BLANKS = "".join(map(chr, range(0x21)))


def has_visible(text: Column) -> Column:
    return text.rlike(VISIBLE)


def split_keeping_empty(text: Column) -> Column:
    """All pieces between spaces, empty ones at either end included."""
    return F.split(text, " ", -1)


def tokens(text: Column) -> Column:
    """Tokens of a text that has a visible character."""
    return split_keeping_empty(F.rtrim(text))


def utf16_length(word: Column) -> Column:
    """Length in UTF-16 units: a character above U+FFFF counts twice."""
    return F.octet_length(F.encode(word, "UTF-16BE")) / 2
