"""Tokens: folding, splitting and the words used by queries and self-tests."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
QUERY_TERM = r"[\p{L}\p{N}_@#.\-]+"
CANDIDATE = r"[A-Za-z][A-Za-z0-9]{5,}"


def _fold_table() -> tuple[str, str]:
    """Characters to replace and their replacements, for ``translate``.

    Rule: a lower-case Latin letter that Unicode decomposes into one ASCII
    letter and one combining mark stands for that letter, and the symbol forms
    of Greek letters, micro and long s stand for the plain letters.  The
    combining marks found on the way come last, without a replacement, which
    removes them where they stand alone.
    """
    pairs, marks = {"ς": "σ"}, set()
    for code in [*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)]:
        base, *added = unicodedata.normalize("NFD", chr(code))
        marks.update(added)
        if len(added) == 1 and base.islower() and base.isascii():
            pairs[chr(code)] = base
    for code in [0x00B5, 0x017F, *range(0x03D0, 0x03F2), 0x03F5]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.islower():
            pairs.setdefault(chr(code), plain)
    return "".join(pairs) + "".join(sorted(marks)), "".join(pairs.values())


_ACCENTED, _PLAIN = _fold_table()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def tokens(c: Column) -> Column:
    """The tokens of a text in order; no tokens for NULL."""
    return F.coalesce(
        F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0)),
        F.array().cast("array<string>"),
    )


def query_terms(c: Column) -> Column:
    """The whitespace/punctuation separated terms of a search query."""
    return F.regexp_extract_all(c, F.lit(QUERY_TERM), F.lit(0))


def candidate_words(c: Column) -> Column:
    """Lower-cased plain words of at least six characters, first uses in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CANDIDATE), F.lit(0)))


def distinctive_word(c: Column) -> Column:
    """The longest candidate word, the earliest of equals; NULL without any."""
    words = F.regexp_extract_all(c, F.lit(CANDIDATE), F.lit(0))
    ranked = F.transform(
        words,
        lambda w, i: F.struct(
            F.length(w).alias("size"), (-i).alias("place"), F.lower(w).alias("word")
        ),
    )
    return F.array_max(ranked)["word"]
