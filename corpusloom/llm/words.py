"""The one definition of a word: a run of characters other than ASCII white space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_GAPS = re.compile(r"[\x20\x09-\x0D]+")
_OTHER_GAPS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_column(text: Column) -> Column:
    """Array of the words of a text; an array without elements for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def count_words(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.size(words_column(text)).cast("long")


def split_words(text: str | None) -> list[str]:
    """The words in Python; str.split() is used where it agrees with the definition."""
    if not text:
        return []
    if text.isascii():
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [w for w in _GAPS.split(text) if w]
        return text.split()
    if _OTHER_GAPS.search(text):
        return [w for w in _GAPS.split(text) if w]
    return text.split()


def lower_ascii(text: str) -> str:
    """A-Z to a-z, all else unchanged."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A dict that a Python worker keeps from task to task for one operator, dropped when another one starts there."""
    for other in [k for k in _caches if k != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {})
