"""White space and phrase helpers; the only place that says what white space is.

Java's ``\\s`` under (?U) covers Unicode white space but not U+001C to U+001F, which belong to it
in the transcripts' home language, so they are named.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """With one space for each run of white space, and none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether any phrase is a substring, whatever the case."""
    low = F.lower(text)
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(low, F.lit(phrase.lower()))
    return found
