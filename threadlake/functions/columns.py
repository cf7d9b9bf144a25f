"""Column expressions that the operators share."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A conversation's identity; all three are always joined together.
ID = ["source_kind", "instance_id", "native_id"]

TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def source_state(coverage: Column, presence: Column) -> Column:
    """unknown while the source's coverage is; else whether the conversation was present."""
    return F.when(coverage == "unknown", "unknown").when(coverage == "complete", presence)


def observed_at(coverage: Column, coverage_at: Column, presence_at: Column) -> Column:
    return F.when(coverage == "unknown", coverage_at).otherwise(presence_at)


def activity(updated: Column, created: Column) -> Column:
    return F.coalesce(updated, created)


def freshness(has_document: Column, latest: tuple[Column, ...], last_good: tuple[Column, ...], outcome: Column) -> Column:
    """untracked, unindexed, current or stale, from the latest observed revision and the last good one."""
    same = F.lit(True)
    for a, b in zip(latest, last_good):
        same = same & a.eqNullSafe(b)
    return (
        F.when(outcome.isNull(), "untracked")
        .when(~has_document, "unindexed")
        .when((outcome == "succeeded") & same, "current")
        .otherwise("stale")
    )


def canonical_timestamp(at: Column) -> Column:
    """A timestamp as YYYY-MM-DDTHH:MM:SS.mmmZ, in the session's time zone, which must be UTC."""
    return F.date_format(at, _FORMAT)


def is_canonical_timestamp(text: Column) -> Column:
    """Whether a string is a canonical timestamp of a day and time that exist; null for null."""
    shaped = text.rlike(TIMESTAMP)
    parsed = F.try_to_timestamp(F.when(shaped, text), F.lit(_FORMAT))
    return F.when(text.isNotNull(), shaped & F.coalesce(canonical_timestamp(parsed) == text, F.lit(False)))


def epoch_millis(ms: Column) -> Column:
    return canonical_timestamp(F.timestamp_millis(ms))


def percent_encoded(text: Column) -> Column:
    """RFC 3986 encoding that leaves only A-Z a-z 0-9 - . _ ~ as they are."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def printable_identity(kind: Column, instance: Column, native: Column) -> Column:
    return F.concat(kind, F.lit("@"), percent_encoded(instance), F.lit(":"), percent_encoded(native))


def parsed_identity(printable: Column) -> Column:
    """(source_kind, instance_id, native_id), or null where the text isn't exactly what printable_identity makes of it."""
    pattern = r"^([a-z0-9]+(?:-[a-z0-9]+)*)@([^:@]+):([^:@]+)$"
    part = lambda i: F.regexp_extract(printable, pattern, i)
    decoded = lambda i: F.try_url_decode(F.replace(part(i), F.lit("+"), F.lit("%2B")))
    found = F.struct(part(1).alias("source_kind"), decoded(2).alias("instance_id"), decoded(3).alias("native_id"))
    exact = printable.rlike(pattern) & (printable_identity(part(1), decoded(2), decoded(3)) == printable)
    return F.when(exact, found)


def truncated_utf8(text: Column, most: Column | int) -> Column:
    """The longest prefix of whole code points within that many UTF-8 bytes."""
    most = F.lit(most) if isinstance(most, int) else most
    raw = F.encode(text, "UTF-8")
    # How many bytes of the code point at the cut lie before it: bytes 80-BF continue one.
    byte = lambda k: F.conv(F.hex(F.substring(raw, most + 1 - k, 1)), 16, 10).cast("int")
    continues = lambda k: F.coalesce((most - k >= 0) & (byte(k) >= 0x80) & (byte(k) < 0xC0), F.lit(False))
    back = F.when(~continues(0), 0).when(~continues(1), 1).when(~continues(2), 2).otherwise(3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), most - back), "UTF-8"))


def among(column: str, values: list) -> Column:
    """column IN values, also as equalities, of which each reaches the scan; a long IN list would only reach it as one range. Of the rows that are read, the list (a hash set) lets few come to the equalities."""
    tests = [F.col(column) == v for v in values]
    while len(tests) > 1:  # a flat tree, as a chain would be as deep as it is long
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return F.col(column).isin(values) & tests[0] if tests else F.lit(False)


@lru_cache(1)
def fold_map() -> tuple[str, str]:
    """Letters that fold to an ASCII letter: those that are one plus a single combining mark; and two single cases."""
    source, target = ["ς", "ſ"], ["σ", "s"]
    for point in range(0xC0, 0x2000):
        c = chr(point)
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            source.append(c)
            target.append(parts[0].lower())
    return "".join(source), "".join(target)


def folded(text: Column) -> Column:
    """Lower case without single diacritics; pure ASCII takes the fast way."""
    source, target = fold_map()
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), source, target))


TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """The search tokens of a text in order."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), 0)
