"""Listing conversations and the manifest of their revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import filters, lineage
from threadlake.operators.library import Library
from threadlake.plans.requests import MANIFEST_LIMIT, ConversationFilter, OperationError

SUMMARY = [*C.ID, "title", "workspace", "created_at", "updated_at", "freshness", "source_state", "captured_at", "observed_at", "adapter_version", "document_digest", "activity"]


def order() -> list[Column]:
    """Latest activity first, none last; then identity in byte order."""
    return [F.desc_nulls_last("activity"), *[F.asc(c) for c in C.ID]]


def after(anchor: tuple) -> Column:
    """Rows that stand after (activity, source_kind, instance_id, native_id) in that order."""
    activity, *identity = anchor
    later = F.struct(*C.ID) > F.struct(*[F.lit(v).alias(c) for c, v in zip(C.ID, identity)])
    if activity is None:
        return F.col("activity").isNull() & later
    return F.col("activity").isNull() | (F.col("activity") < activity) | ((F.col("activity") == activity) & later)


def conversations(library: Library, f: ConversationFilter = ConversationFilter()) -> DataFrame:
    """Summaries of all retained conversations that pass the filter, unordered."""
    return library.retained().where(filters.conversations(f)).select(*SUMMARY)


def page(library: Library, f: ConversationFilter, limit: int, anchor: tuple | None = None) -> DataFrame:
    """limit + 1 summaries after the anchor, in order: the extra one tells whether there is another page."""
    rows = conversations(library, f)
    if anchor is not None:
        rows = rows.where(after(anchor))
    return rows.orderBy(*order()).limit(limit + 1)


def metrics(library: Library) -> DataFrame:
    """relation, entry, segment and omitted counts and UTF-8 bytes of text of every document: as stored with it, or worked out."""
    stored = library.stored("metrics")
    return computed_metrics(library) if stored is None else stored


def computed_metrics(library: Library) -> DataFrame:
    """metrics(), worked out from the rows and the texts.

    A segment whose content is missing makes text_bytes -1, which readers take for corruption.
    """
    relations = library["relations"].groupBy(*C.ID).agg(F.count("*").alias("relation_count"))
    entries = library["entries"].groupBy(*C.ID).agg(F.count("*").alias("entry_count"))
    sizes = library["contents"].select("digest", F.octet_length("text").cast("long").alias("bytes"))
    placed = library["occurrences"].join(sizes, "digest", "left")
    dangling = F.col("digest").isNotNull() & F.col("bytes").isNull()
    segments = placed.groupBy(*C.ID).agg(
        F.count("*").alias("segment_count"),
        F.count_if(F.col("digest").isNull()).alias("omitted_count"),
        F.when(F.count_if(dangling) > 0, -1).otherwise(F.coalesce(F.sum("bytes"), F.lit(0))).alias("text_bytes"),
    )
    out = library["documents"].select(*C.ID)
    for part in (relations, entries, segments):
        out = out.join(part, C.ID, "left")
    return out.fillna(0, ["relation_count", "entry_count", "segment_count", "omitted_count", "text_bytes"])


def manifest(library: Library, f: ConversationFilter = ConversationFilter()) -> DataFrame:
    """Every retained revision that passes the filter, with its metrics and root, unordered; no transcript text is read beyond sizes."""
    rows = library.retained().where(filters.conversations(f))
    joined = rows.join(metrics(library), C.ID, "left")
    checked = joined.where(F.assert_true(F.coalesce(F.col("text_bytes") >= 0, F.lit(False)), "corrupt-data: metrics are missing").isNull())
    return lineage.with_root(checked, library).select(
        *C.ID, "document_digest", "created_at", "updated_at", "captured_at", "observed_at", "source_state", "freshness", "adapter_version", "lineage_coverage", "root",
        "relation_count", "entry_count", "segment_count", "omitted_count", "text_bytes",
    )


def manifest_rows(library: Library, f: ConversationFilter = ConversationFilter(), most: int = MANIFEST_LIMIT) -> list:
    """The manifest in identity order; one that is too large fails rather than being cut."""
    rows = manifest(library, f).orderBy(*C.ID).limit(most + 1).collect()
    if len(rows) > most:
        raise OperationError("manifest-too-large", f"the selection has more than {most} conversations")
    return rows
