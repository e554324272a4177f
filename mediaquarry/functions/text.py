"""Search tokens: runs of letters, digits and private-use characters, case and accents folded."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

from .binding import let

_MARKS = r"[\u0300-\u0331]"
_BREAK = r"[^\p{L}\p{N}\p{Co}]+"
_RUN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\u0300-\u0331]*"


def _accent_table() -> tuple[str, str]:
    """Every letter that is one plain Latin letter and one combining mark."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            accented.append(chr(code))
            plain.append(parts[0].lower())
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def fold_text(text: Column) -> Column:
    """Lower case without accents; plain ASCII skips the per-character work."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.when(
        low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, ACCENTED, PLAIN), _MARKS, "")
    ).otherwise(low))


def tokenize(text: Column) -> Column:
    """``array<string>`` in reading order; an unbroken CJK run is one token."""
    return F.array_remove(F.split(fold_text(text), _BREAK), "")


def token_count(text: Column) -> Column:
    """``size(tokenize(text))`` without building the tokens: folding joins and splits no run."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_RUN))


def query_terms(query: str) -> list[list[str]]:
    """Whitespace terms of what a user typed, each as its tokens; terms without tokens vanish.

    The text is data and never reaches a SQL string.
    """
    fold = str.maketrans(dict(zip(ACCENTED, PLAIN)))
    terms = []
    for word in query.split():
        tokens, current = [], ""
        for ch in unicodedata.normalize("NFC", word.lower()) + " ":
            category = unicodedata.category(ch)
            if category[0] in "LN" or category == "Co":
                current += ch.translate(fold)
            elif current and re.match(_MARKS, ch):
                continue
            elif current:
                tokens.append(current)
                current = ""
        if tokens:
            terms.append(tokens)
    return terms
