"""Text primitives as Column functions, with Unicode classes that agree with Python's str methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters as Python sees them, for use inside a character class (fixed values).
WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORDCHARS = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def whitespace_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{WS}]+"), 0)


def normalized_words(c: Column) -> Column:
    """Lower-cased words; one empty word for a blank text."""
    words = whitespace_tokens(F.lower(c))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))


def estimate_tokens(c: Column) -> Column:
    """Runs of word characters, and every other character that is not white space."""
    return F.regexp_count(c, F.lit(f"[{WORDCHARS}]+|[^{WS}{WORDCHARS}]")).cast("long")


def hash32(c: Column) -> Column:
    """The first 32 bits of the MD5, as a long: the same in every engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def u01(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed, the same in every run and partitioning."""
    return hash32(F.concat(F.lit(f"{seed}:"), key.cast("string"))) / F.lit(4294967296.0)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable, not an expression repeated wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams of an array of words, joined by single spaces; none if there are fewer words."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))

    return let(words, of)


def code_blocks(c: Column) -> Column:
    """Stripped bodies of fenced blocks; without one, the whole stripped text if there is any."""
    blocks = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```(?:[a-zA-Z0-9_+-]*)\n(.*?)```"), 1), strip)
    whole = F.when(strip(c) != "", F.array(strip(c))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(blocks) > 0, blocks).otherwise(whole)


def first_nonempty(*columns: Column) -> Column:
    """The first value that is neither null nor ''; '' if there is none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))
