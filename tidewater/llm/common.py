"""Shared plumbing of the corpus operators: scratch tables, bounded broadcasts, word rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.core.shared import broadcast_if_small, scratch

__all__ = ["RANGE_BYTES", "SPACES", "WORD", "broadcast_if_small", "fresh", "prime_below", "range_count", "scratch", "words_of"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Bytes of text behind one hash range; a reducer holds one range at a time.
RANGE_BYTES = 4 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text):
    """Array of the words of a text column; null or blank text has none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACES}|{SPACES}\z", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def range_count(df: DataFrame, text: str) -> int:
    """A power of two of ranges so that each stands for about ``RANGE_BYTES`` of text."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(64, 1 << (int(total // RANGE_BYTES)).bit_length())


def prime_below(n: int) -> int:
    """The largest prime up to ``n``: identifiers modulo it are spread whatever their stride."""
    return next(p for p in range(n, 1, -1) if all(p % d for d in range(2, int(p**0.5) + 1)))
