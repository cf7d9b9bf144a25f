"""The inventory of entries: selection, segment counts and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import columns as C
from threadlake.operators import filters
from threadlake.operators.library import Library
from threadlake.plans.requests import EntryFilter

KEY = [*C.ID, "ordinal"]
PREVIEW_BYTES = 512


def selected(library: Library, f: EntryFilter = EntryFilter(), selection: str = "all") -> DataFrame:
    """Entries that pass the filter; of each conversation all, or the first or last by ordinal of those."""
    spine = library.retained().where(filters.conversations(f)).select(*C.ID)
    rows = library["entries"].where(filters.entries(f)).join(spine, C.ID, "left_semi")
    rows = filters.with_origin(rows, library["occurrences"], f.origin)
    if selection == "all":
        return rows
    order = F.asc("ordinal") if selection == "first" else F.desc("ordinal")
    rank = F.row_number().over(Window.partitionBy(*C.ID).orderBy(order))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank")


def after(anchor: tuple) -> Column:
    return F.struct(*KEY) > F.struct(*[F.lit(v).alias(c) for c, v in zip(KEY, anchor)])


def page(library: Library, f: EntryFilter, selection: str, limit: int, anchor: tuple | None = None) -> DataFrame:
    """limit + 1 entries in the order of identity and ordinal; contents are joined after the cut."""
    rows = selected(library, f, selection)
    if anchor is not None:
        rows = rows.where(after(anchor))
    return rows.orderBy(*KEY).limit(limit + 1)


def segment_counts(rows: DataFrame, library: Library) -> DataFrame:
    """text_segments and omitted_segments of each entry; one without segments has 0 of both."""
    own = library["occurrences"].join(rows.select(*KEY), KEY, "left_semi")
    segments = own.groupBy(*KEY).agg(F.count("digest").alias("text_segments"), F.count_if(F.col("digest").isNull()).alias("omitted_segments"))
    return rows.join(segments, KEY, "left").fillna(0, ["text_segments", "omitted_segments"])


def previews(rows: DataFrame, library: Library, origin: str | None = None, most: int = PREVIEW_BYTES) -> DataFrame:
    """The first text segment (of that origin) of each entry, cut to whole code points: preview, preview_segment, preview_truncated."""
    texts = library["occurrences"].where("digest IS NOT NULL")
    if origin is not None:
        texts = texts.where(F.col("origin") == origin)
    first = texts.join(rows.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min(F.struct("segment_ordinal", "digest")).alias("s"))
    found = first.select(*KEY, "s.segment_ordinal", "s.digest").join(library["contents"], "digest")
    cut = found.select(
        *KEY, F.col("segment_ordinal").alias("preview_segment"), C.truncated_utf8(F.col("text"), most).alias("preview"), (F.octet_length("text") > most).alias("preview_truncated")
    )
    return rows.join(cut, KEY, "left")


def bodies(rows: DataFrame, library: Library) -> DataFrame:
    """body: an entry's text segments in order, joined by line feeds; null where it has none."""
    texts = rows.select(*KEY).join(library["occurrences"].where("digest IS NOT NULL"), KEY).join(library["contents"], "digest")
    parts = F.array_sort(F.collect_list(F.struct("segment_ordinal", "text")))
    joined = texts.groupBy(*KEY).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("body"))
    return rows.join(joined, KEY, "left")


def adjacent(primary: DataFrame, library: Library, context: int) -> DataFrame:
    """Entries within context ordinals of each primary one (KEY), itself left out: KEY, context_ordinal."""
    around = primary.select(*KEY, F.explode(F.sequence(F.col("ordinal") - context, F.col("ordinal") + context)).alias("context_ordinal")).where("context_ordinal <> ordinal")
    there = library["entries"].select(*C.ID, F.col("ordinal").alias("context_ordinal"))
    return around.join(there, [*C.ID, "context_ordinal"]).select(*KEY, "context_ordinal")


def partners(library: Library, primary: DataFrame | None = None) -> DataFrame:
    """Tool calls and results that refer to each other, in both directions: KEY, partner; of the conversations of primary where it is given."""
    e = library["entries"].where("entry_kind IN ('tool-call', 'tool-result')").select(*C.ID, "ordinal", "entry_kind", "related_ordinal")
    if primary is not None:
        e = e.join(primary.select(*C.ID).distinct(), C.ID, "left_semi")
    other = e.select(*C.ID, F.col("ordinal").alias("related_ordinal"), F.col("entry_kind").alias("other_kind"))
    pairs = e.where("related_ordinal IS NOT NULL").join(other, [*C.ID, "related_ordinal"]).where("entry_kind <> other_kind")
    forward = pairs.select(*C.ID, "ordinal", F.col("related_ordinal").alias("partner"))
    return forward.unionByName(forward.select(*C.ID, F.col("partner").alias("ordinal"), F.col("ordinal").alias("partner"))).distinct()


LINKED = 20


def linked(primary: DataFrame, library: Library, context: int, most: int = LINKED) -> DataFrame:
    """Tool partners beyond the adjacent context, the first `most` by ordinal: KEY, partner, linked_truncated."""
    beyond = primary.select(*KEY).join(partners(library, primary), KEY).where(F.abs(F.col("partner") - F.col("ordinal")) > context)
    w = Window.partitionBy(*KEY)
    ranked = beyond.withColumn("rank", F.row_number().over(w.orderBy("partner"))).withColumn("linked_truncated", F.count("*").over(w) > most)
    return ranked.where(F.col("rank") <= most).drop("rank")
