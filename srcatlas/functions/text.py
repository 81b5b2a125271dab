"""Column functions on text and bytes: tokens, identifier expansion, line numbers, digests."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: maximal runs of letters and digits
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


_IN = r"[\p{L}\p{N}]"


@cache
def _accents() -> tuple[str, str]:
    """Letters with marks and their base letters, by canonical decomposition; combining marks, which fall away, come last."""
    base = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x2000) if unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))}
    pairs = [(a, b) for a, b in base.items() if a != b]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


def lowered(text: Column) -> Column:
    """Lower case without diacritics; empty for null.  Plain ASCII, which most text is, is not mapped."""
    t = F.coalesce(text, F.lit(""))
    a, b = _accents()
    return F.lower(F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, a, b)).otherwise(t))


def fold(text: str) -> str:
    """``lowered`` of one string."""
    a, b = _accents()
    return text.translate({ord(x): b[i] if i < len(b) else None for i, x in enumerate(a)}).lower()


def count_tokens(low: Column) -> Column:
    """Tokens of a lower-case text, counted without making them."""
    return F.regexp_count(low, F.lit(TOKEN))


def count_token(low: Column, term: str) -> Column:
    """Tokens of a lower-case text that equal the term (letters and digits)."""
    return F.regexp_count(low, F.lit(f"(?<!{_IN}){term}(?!{_IN})"))


def count_phrase(low: Column, terms: list[str]) -> Column:
    """Places, overlapping ones too, at which the terms are successive tokens of a lower-case text."""
    return F.regexp_count(low, F.lit(f"(?<!{_IN})(?=" + r"[^\p{L}\p{N}]+".join(terms) + f"(?!{_IN}))"))


def expand_identifiers(name: Column) -> Column:
    """Words of an identifier in lower case: split before an upper-case letter after a lower-case one or a digit,
    before the last of several upper-case letters that a lower-case one follows, and at everything that is no letter or digit."""
    s = F.regexp_replace(name, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 ")
    s = F.regexp_replace(s, r"([\p{Ll}0-9])(?=\p{Lu})", "$1 ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}]", " ")
    return F.lower(s)


def line_of(data: Column, at: Column) -> Column:
    """Line number, from 1, of a byte offset: bytes are counted through their hexadecimal text, so any encoding is safe."""
    digits = F.hex(F.substring(data, F.lit(1), at))
    # line ends stand at even positions: pairs are separated first
    pairs = F.regexp_replace(digits, "(..)", "$1 ")
    return (F.lit(1) + F.length(pairs) - F.length(F.replace(pairs, F.lit("0A "), F.lit("0A")))).cast("long")


def text_line_of(text: Column, at: Column) -> Column:
    """Line number of a character offset."""
    head = F.substring(text, F.lit(1), at)
    return (F.lit(1) + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("long")


def content_revision(data: Column) -> Column:
    return F.sha2(data, 256)
