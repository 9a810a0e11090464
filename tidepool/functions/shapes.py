"""Shapes of keys and secrets in texts, as predicates on string columns; null texts have none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of keys, and how many words a recovery phrase has.
BASE58 = "[1-9A-HJ-NP-Za-km-z]"
PHRASE_WORDS = (12, 15, 18, 21, 24)


def _any_word(text: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(F.split(text, " "), lambda w: w.rlike(pattern)), F.lit(False))


def has_public_key(text: Column) -> Column:
    """A word of 32 to 44 letters of the key alphabet."""
    return _any_word(text, f"^{BASE58}{{32,44}}\\z")


def has_raw_key(text: Column) -> Column:
    """A word of 50 letters of the key alphabet or more."""
    return _any_word(text, f"^{BASE58}{{50,}}\\z")


def is_key_array(text: Column, least: int = 32) -> Column:
    """A JSON array of at least so many integers from 0 to 65 535, with spaces around any of them."""
    inner = F.regexp_extract(text, r"(?s)^\s*\[(.*)\]\s*\z", 1)
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_extract(x, r"^\s*\+?0*([0-9]{1,5})\s*\z", 1))
    return F.coalesce((F.size(parts) >= least) & F.forall(parts, lambda x: F.coalesce(x.try_cast("int"), F.lit(65_536)) <= 65_535), F.lit(False))


def is_phrase(text: Column) -> Column:
    """Exactly as many words as a recovery phrase has, each of three to eight letters, all lower or all upper case."""
    cased = text.rlike("^[a-z]{3,8}( [a-z]{3,8})*\\z") | text.rlike("^[A-Z]{3,8}( [A-Z]{3,8})*\\z")
    return F.coalesce(F.size(F.split(text, " ")).isin(*PHRASE_WORDS) & cased, F.lit(False))
