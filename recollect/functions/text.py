"""Text expressions. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

WORD = r"([\p{L}\p{N}]+)"
SENTENCE_END = r"[.!?\n]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(1))


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty sentences in order."""
    col = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(col, SENTENCE_END), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def trigrams(term: Column | str) -> Column:
    """Distinct runs of three characters; empty for shorter terms."""
    col = F.col(term) if isinstance(term, str) else term
    starts = F.sequence(F.lit(1), F.greatest(F.length(col) - 2, F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(col, i, F.lit(3))))
    return F.when(F.length(col) >= 3, grams).otherwise(F.array().cast("array<string>"))


def one_edit_keys(term: Column | str) -> Column:
    """Hashes of the term and of the term less one character.

    Two terms within edit distance 1 always share such a key. A key is shared
    by at most (length + 1) x (alphabet size) terms, so no key can be hot.
    """
    col = F.col(term) if isinstance(term, str) else term
    spots = F.sequence(F.lit(1), F.greatest(F.length(col), F.lit(1)))
    cut = F.transform(
        spots,
        lambda i: F.xxhash64(
            F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col)))
        ),
    )
    return F.array_distinct(F.concat(F.array(F.xxhash64(col)), cut))


def word_runs(words: Column, lengths: Iterable[int]) -> Column:
    """Distinct runs of neighbouring tokens of the given lengths, each joined by blanks."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(empty, *[_runs_of(words, n) for n in lengths]))


def _runs_of(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))
