"""Word and shingle expressions of Spark SQL that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: blank, and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
SHINGLE = 5


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are; pure ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of the lower-cased text; none for null, empty and blank texts."""
    trimmed = F.btrim(ascii_lower(text), F.lit(BLANKS))
    return F.when(F.octet_length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(word_list: Column, width: int = SHINGLE) -> Column:
    """The 64-bit hash of every run of width words, in order, repeats included."""
    n = F.size(word_list)
    each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(word_list, i + k) for k in range(width)]))
    return F.when(n >= width, each).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(word_list: Column, width: int = SHINGLE) -> Column:
    """The distinct runs of width words, each joined by blanks; a shorter text is one shingle, an empty one none."""
    n = F.size(word_list)
    each = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(word_list, i, width), " "))
    return F.array_distinct(
        F.when(n >= width, each).when(n > 0, F.array(F.array_join(word_list, " "))).otherwise(F.array().cast("array<string>"))
    )
