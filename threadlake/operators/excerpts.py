"""Excerpts of texts that match a search: the window of 64 tokens that holds the most of its phrases.

A window is worth 1000 for each phrase that occurs in it and 1 for each further occurrence. It begins
so that the occurrences lie in its middle, or, which is worth 100 more (120 at the text's beginning),
where the sentence of an occurrence does. Of equal windows the first one that an occurrence asks for
is taken. What is over 512 bytes is cut around the window's first occurrence, a quarter before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from threadlake.functions import columns as C

TOKENS, BYTES = 64, 512
GAP = " … "


def _text() -> WindowSpec:
    return Window.partitionBy("digest")


def _ordered() -> WindowSpec:
    return _text().orderBy("at")


def _after() -> WindowSpec:
    """The tokens behind this one, counted from the last: growing frames are worked out once, those that end with the partition anew for each row."""
    return _text().orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)


def _lists(text: str) -> tuple[Column, Column]:
    """A text's tokens as written, and what stands before each of them and behind the last."""
    return F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(0)), F.split(text, C.TOKEN, -1)


def _marks(texts: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """One row for each token that begins an occurrence or a sentence: digest, many (tokens of its text), at (its number from 0), opens (a sentence) and here_p (0 or 1) for each phrase.

    They are found within the text's row: no other token becomes one.
    """
    listed = texts.select("digest", C.tokens(F.col("text")).alias("terms"), _lists("text")[1].alias("gaps")).where(F.size("terms") > 0)
    here = lambda x, i, phrase: reduce(lambda a, b: a & b, [(F.get("terms", i + j) if j else x["terms"]).eqNullSafe(F.lit(t)) for j, t in enumerate(phrase)])
    mark = lambda x, i: F.struct(i.alias("at"), ((i == 0) | x["gaps"].rlike(r"[.:][ \t\n\r]+\z")).alias("opens"), *[here(x, i, p).cast("int").alias(f"here_{n}") for n, p in enumerate(phrases)])
    each = F.transform(F.slice(F.arrays_zip("terms", "gaps"), F.lit(1), F.size("terms")), mark)
    told = F.filter(each, lambda m: reduce(lambda a, b: a | b, [m[f"here_{n}"] == 1 for n in range(len(phrases))], m["opens"]))
    return listed.select("digest", F.size("terms").alias("many"), F.explode(told).alias("m")).select("digest", "many", "m.*")


def windows(texts: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """digest, many, first (the window's first token) and hit (the first one in it that begins an occurrence), of each text (digest, text) that has an occurrence.

    A text's occurrences and sentences are sorted in one task, so memory is bounded by the longest text.
    """
    rows = _marks(texts, phrases)
    here = [F.col(f"here_{p}") for p in range(len(phrases))]
    inside = _ordered().rangeBetween(0, TOKENS - 1)
    total = reduce(lambda a, b: a + b, here)
    # Occurrences at one token are in the order of their phrases: the last one tells where the window's occurrences end.
    reach = F.coalesce(*[F.when(here[p] == 1, F.lit(len(phrases[p]))) for p in reversed(range(len(phrases)))])
    rows = rows.withColumns({"total": total, "reach": F.when(total > 0, F.col("at") + reach)})
    kinds = reduce(lambda a, b: a + b, [F.max(h).over(inside) for h in here])
    last = F.max(F.when(F.col("total") > 0, F.struct("at", "reach"))).over(inside)["reach"]
    next_hit, next_opening = (F.min(F.when(c, F.col("at"))).over(_after()) for c in (F.col("total") > 0, F.col("opens")))
    rows = rows.withColumns({"kinds": kinds, "sum": F.sum("total").over(inside), "last": last, "next_hit": next_hit, "next_opening": next_opening})
    worth = F.col("kinds") * 1000 + F.col("sum") - F.col("kinds")
    centred = F.col("at") - F.expr(f"({TOKENS} - (last - at)) div 2")
    centred = F.greatest(F.least(centred, F.col("many") - TOKENS), F.lit(0)).cast("int")
    candidate = lambda test, score, asked, kind, first: F.when(test, F.struct(score.alias("score"), (-asked).alias("asked"), F.lit(-kind).alias("kind"), first.alias("first")))
    of_hit = candidate(F.col("total") > 0, worth, F.col("at"), 0, centred)
    asked = (F.col("many") > TOKENS) & F.col("opens") & (F.col("next_hit") < F.coalesce("next_opening", F.col("many")))
    of_sentence = candidate(asked, worth + F.when(F.col("at") == 0, 120).otherwise(100), F.col("next_hit"), 1, F.col("at"))
    best = F.max(F.greatest(of_hit, of_sentence)).over(_text())["first"]
    hit = F.min(F.when((F.col("total") > 0) & (F.col("at") >= F.col("first")), F.col("at")))
    return rows.withColumn("first", best).where("first IS NOT NULL").groupBy("digest", "many", "first").agg(hit.alias("hit"))


def _suffix(text: Column, most: int) -> Column:
    """The longest suffix of whole code points within that many UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    start = F.octet_length(text) - most
    byte = lambda k: F.conv(F.hex(F.substring(raw, start + 1 + k, F.lit(1))), 16, 10).cast("int")
    continues = lambda k: F.coalesce((byte(k) >= 0x80) & (byte(k) < 0xC0), F.lit(False))
    skipped = F.when(~continues(0), 0).when(~continues(1), 1).when(~continues(2), 2).otherwise(3)
    return F.when(start <= 0, text).otherwise(F.decode(F.substring(raw, start + 1 + skipped, F.lit(most)), "UTF-8"))


def excerpts(texts: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """digest, excerpt (the whole window), snippet (512 bytes of it at most) and snippet_truncated (it is less than the text), of each text (digest, text).

    Texts without an occurrence, or a search without tokens, give the text's beginning; a null text gives nulls.
    """
    raw, gaps = _lists("text")
    if phrases:
        found = texts.join(windows(texts, phrases), "digest", "left")
    else:
        found = texts.withColumns({c: F.lit(None).cast("int") for c in ("many", "first", "hit")})
    found = found.withColumns({"raw": raw, "gaps": gaps})
    found = found.withColumn("sizes", F.transform(F.arrays_zip("raw", "gaps"), lambda x: F.char_length(F.coalesce(x["raw"], F.lit(""))) + F.char_length(x["gaps"])))
    behind = lambda k: F.aggregate(F.slice("sizes", F.lit(1), k + 1), F.lit(0), lambda a, x: a + x)
    ahead = lambda k: behind(k) - F.char_length(F.get("raw", k))
    found = found.withColumns({"low": ahead(F.col("first")), "high": behind(F.col("first") + TOKENS - 1), "anchor": ahead(F.col("hit"))})
    ends = F.col("first") + TOKENS >= F.col("many")
    begin = F.when(F.col("first") == 0, 0).otherwise(F.col("low")).cast("int")
    end = F.when(ends, F.char_length("text")).otherwise(F.col("high")).cast("int")
    lead = F.when(F.col("first") == 0, "").otherwise(GAP)
    window = F.concat(lead, F.substring(F.col("text"), begin + 1, end - begin), F.when(ends, "").otherwise(GAP))
    found = found.withColumns({"excerpt": F.coalesce(window, "text"), "anchor": F.coalesce(F.col("anchor") - begin + F.char_length(lead), F.lit(0)).cast("int")})
    before = _suffix(F.substring(F.col("excerpt"), F.lit(1), F.col("anchor")), BYTES // 4)
    after = F.substring(F.col("excerpt"), F.col("anchor") + 1, F.char_length("excerpt"))
    around = F.concat(before, C.truncated_utf8(after, BYTES - F.octet_length(before)))
    shown = found.withColumn("snippet", F.when(F.octet_length("excerpt") <= BYTES, F.col("excerpt")).otherwise(around))
    return shown.select("digest", "excerpt", "snippet", (F.col("snippet") != F.col("text")).alias("snippet_truncated"))
