"""The best hits of a query over a stored index, without reading what can't be among them.

A block's bound is the score that a text would have that combined the most occurrences and
the least length of the block, for each phrase. Blocks are read by falling bound, some at
first and eight times as many each time, until the page is full of hits that score better
than the bound of what wasn't read. Only bounds of blocks and the page go to the driver.
The result is the same as if every text had been scored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import entries as E
from threadlake.operators import search
from threadlake.operators.library import SCHEMAS, Library
from threadlake.plans.requests import EntryFilter

#: Blocks that are read first, the growth from round to round, and the most that are named one by one; beyond it all are read.
FIRST, GROWTH, LISTED = 8, 8, 512
#: Bounds and scores are sums of the same terms in another order.
SLACK = 1e-9
_HIT = "source_kind string, instance_id string, native_id string, ordinal long, segment_ordinal long, digest string, score double, activity string, additional_segments long, matched_terms array<string>"


@dataclass(frozen=True)
class Found:
    """A page of hits, and how many of the query's blocks were read of how many there are."""

    hits: DataFrame
    blocks_read: int
    blocks: int


def bounds(found: search.Index, phrases: list[list[str]], idf: list[float], mode: str) -> DataFrame:
    """block, bound: what a text of the block scores at most (scores here are the better the higher)."""
    wanted = sorted({t for p in phrases for t in p})
    held = found.blocks.where(F.col("term").isin(wanted)).groupBy("block", "term").agg(F.sum("texts").alias("texts"), F.max("most").alias("most"), F.min("least").alias("least")).where("texts > 0")
    # A phrase occurs no more often than the rarest of its tokens, in a text no shorter than any of theirs.
    own = held.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("most", "least")))).alias("of"))
    bound, match = F.lit(0.0), F.lit(mode == "all")
    for phrase, w in zip(phrases, idf):
        if not phrase:
            continue
        each = [F.col("of")[t] for t in phrase]
        there = reduce(lambda a, b: a & b, [e.isNotNull() for e in each])
        tf = reduce(F.least, [e["most"] for e in each])
        length = reduce(F.greatest, [e["least"] for e in each])
        bound = bound + F.when(there, w * search.strength(tf, length, found.mean_length)).otherwise(0.0)
        match = (match & there) if mode == "all" else (match | there)
    return own.where(match).select("block", bound.alias("bound"))


def page(library: Library, text: str, f: EntryFilter = EntryFilter(), mode: str = "all", limit: int = 20, offset: int = 0, found: search.Index | None = None) -> Found:
    """search.page() of a library with a stored index."""
    found, phrases = found or search.index(library), search.parsed(text, mode)
    nothing = library.spark.createDataFrame([], _HIT)
    if phrases is None:
        return Found(nothing, 0, 0)
    idf = search.weights(found, search.text_counts(found, phrases))
    ranked = bounds(found, phrases, idf, mode).orderBy(F.desc("bound"), "block").limit(LISTED + 1).collect()
    total = bounds(found, phrases, idf, mode).count() if len(ranked) > LISTED else len(ranked)
    want, read, top = offset + limit + 1, min(FIRST, len(ranked)), []
    while ranked:
        some = read <= LISTED
        held = replace(found, postings=found.postings.where(C.among("block", [r["block"] for r in ranked[:read]]))) if some else found
        texts = search.rated(search.matched(search.phrase_counts(held, phrases), len(phrases), mode), found, idf).drop("block", "length")
        rest = ranked[read]["bound"] if some and read < len(ranked) else None
        top = _best(texts, library, f, text, mode, want, rest)
        if rest is None or _full(top, want, rest):
            break
        read = min(read * GROWTH, len(ranked)) if read * GROWTH <= LISTED or len(ranked) <= LISTED else len(ranked)
    counted = total if read > LISTED else min(read, total)
    shown = top[offset:]
    return Found(_completed(shown, library, found, f, phrases, text, mode) if shown else nothing, counted, total)


def _full(top: list, want: int, rest: float) -> bool:
    """Whether no text that scores `rest` or less can be on the page."""
    return len(top) == want and -top[-1]["score"] > rest * (1 + SLACK) + SLACK


def _best(texts: DataFrame, library: Library, f: EntryFilter, text: str, mode: str, want: int, rest: float | None) -> list:
    """The first `want` hits of these texts. Those of the best texts are looked up alone, by digest and conversation, and are enough if they fill the page."""
    ordered = lambda lib, some, where: search.hits(search.located(some, where, lib, f), text, mode).orderBy(*search.order()).limit(want).collect()
    named = texts.orderBy("score", "digest").limit(LISTED + 1).collect()
    some = library.spark.createDataFrame(named[:LISTED], texts.schema)
    where = search.places(library).where(C.among("digest", [r["digest"] for r in named[:LISTED]]))
    ids = [r["native_id"] for r in where.select("native_id").distinct().limit(LISTED + 1).collect()]
    near = library if len(ids) > LISTED else library.near(ids)
    top = ordered(near, some, where)
    if len(named) <= LISTED or _full(top, want, -named[LISTED]["score"]):
        return top
    return ordered(library, texts, search.places(library))


def _completed(shown: list, library: Library, found: search.Index, f: EntryFilter, phrases: list[list[str]], text: str, mode: str) -> DataFrame:
    """The page with what takes all segments of its entries: how many others match, and the terms that any of them has. Their texts are matched anew."""
    spark = library.spark
    keys = spark.createDataFrame([tuple(r[k] for k in E.KEY) for r in shown], "source_kind string, instance_id string, native_id string, ordinal long")
    ids = sorted({r["native_id"] for r in shown})
    segments = library.near(ids)["occurrences"].where("digest IS NOT NULL")
    if f.origin is not None:
        segments = segments.where(F.col("origin") == f.origin)
    rows = segments.join(F.broadcast(keys), E.KEY, "left_semi").select(*E.KEY, "segment_ordinal", "digest").collect()
    own = sorted({r["digest"] for r in rows})
    texts = library["contents"].where(C.among("digest", own)) if len(own) <= LISTED else library["contents"].join(F.broadcast(spark.createDataFrame([(d,) for d in own], "digest string")), "digest", "left_semi")
    counts = search.phrase_counts(replace(found, contents=texts), phrases)
    known = spark.createDataFrame(rows, "source_kind string, instance_id string, native_id string, ordinal long, segment_ordinal long, digest string")
    match = known.join(search.matched(counts, len(phrases), mode), "digest")
    whole = search.hits(match.withColumns({"score": F.lit(0.0), "activity": F.lit(None).cast("string")}), text, mode).select(*E.KEY, "additional_segments", "matched_terms")
    best = spark.createDataFrame(shown, _HIT).drop("additional_segments", "matched_terms")
    return best.join(whole, E.KEY).orderBy(*search.order())
