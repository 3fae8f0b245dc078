"""The header line of a transcript message: date, time, sender, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import SPACE as S

# The header grammar of exported chats, and the phrases of notices that aren't messages.
GRAMMAR = r"^\[?(\d{1,2}/\d{1,2}/\d{2,4}),?\s(\d{1,2}:\d{2}(?::\d{2})?\s?[APap]?[Mm]?)\]?\s?-?\s?([^:]+):\s(.*)$"
NOTICES = (
    "Messages and calls are end-to-end encrypted",
    "changed the subject",
    "changed this group's icon",
    "added",
    "left",
    "removed",
    "created group",
    "changed the group description",
    "You deleted this message",
    "<Media omitted>",
)
DELETED = ("<media omitted>", "this message was deleted")

#: The same for Java: any character after the colon, Unicode digits and white space, and nothing after the end.
HEADER = "(?sU)" + GRAMMAR.removesuffix("$").replace(r"\s", S) + r"\z"

_MARK = "\x01"


def captures(line: Column) -> Column:
    """[date, time, sender, text] of a header line; null for any other line.

    One replacement joins the four groups by a mark, so the pattern runs once; a line that holds
    the mark itself is taken apart group by group.
    """
    joined = F.regexp_replace(line, HEADER, _MARK.join(f"${k}" for k in range(1, 5)))
    fast = F.split(joined, _MARK)
    slow = F.when(F.regexp_like(line, F.lit(HEADER)), F.array(*(F.regexp_extract(line, HEADER, k) for k in range(1, 5))))
    return F.when(F.contains(line, F.lit(_MARK)), slow).otherwise(F.when(F.size(fast) == 4, fast))
