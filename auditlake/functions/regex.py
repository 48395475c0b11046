"""Patterns shared by Spark and the checks in SQL.

Patterns are written with ``\\b`` for an edge of an ASCII word. Java's ``\\b`` counts accented letters as
word characters, so for Spark the edge is spelled out with look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Blanks as JavaScript sees them.
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def edged(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + edged(pattern))


def every(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """All matches, as an array."""
    return F.regexp_extract_all(text, F.lit(("(?i)" if ignore_case else "") + edged(pattern)), F.lit(group))


def count(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(("(?i)" if ignore_case else "") + edged(pattern)))
