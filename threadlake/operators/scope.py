"""Capture scope: how complete the library is for a filter, as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators import filters
from threadlake.operators.library import Library
from threadlake.plans.requests import ConversationFilter

# Why the latest reading of a conversation can have failed.
FAILURES = ("unavailable", "unreadable", "malformed", "source-changed", "unsupported-format", "repository-write")


def coverage_counts(library: Library, f: ConversationFilter = ConversationFilter()) -> DataFrame:
    """Over source instances, those without conversations too."""
    s = library["sources"]
    if f.source is not None:
        s = s.where(F.col("source_kind") == f.source)
    if f.instance is not None:
        s = s.where(F.col("instance_id") == f.instance)
    if f.conversation is not None:
        s = s.where((F.col("source_kind") == f.conversation[0]) & (F.col("instance_id") == f.conversation[1]))
    return s.agg(
        F.count("*").alias("source_instances"),
        F.count_if(F.col("coverage_status") == "complete").alias("complete_sources"),
        F.count_if(F.col("coverage_status") == "unknown").alias("unknown_sources"),
    )


def capture_scope(library: Library, f: ConversationFilter = ConversationFilter()) -> DataFrame:
    """One row over all tracked conversations, retained or not; an unrecognised failure code stops the query. Only assessed filters narrow it."""
    narrowed = ConversationFilter(source=f.source, instance=f.instance, native_id=f.native_id, source_state=f.source_state, conversation=f.conversation)
    spine = library.spine().where(filters.conversations(narrowed))
    code, retained = F.col("latest_failure"), F.col("has_document")
    known = code.isNull() | code.isin(*FAILURES)
    counts = spine.agg(
        F.count("*").alias("tracked"),
        F.count_if(retained).alias("retained"),
        *[F.count_if(F.col("freshness") == s).alias(s) for s in ("current", "stale", "unindexed")],
        *[F.count_if(F.col("source_state") == s).alias(f"source_{s}") for s in ("present", "missing", "unknown")],
        *[F.count_if(code == c).alias("failed_" + c.replace("-", "_")) for c in FAILURES],
        F.count_if(~known).alias("unrecognised"),
    )
    joined = counts.crossJoin(coverage_counts(library, f))  # one row each
    whole = (F.col("source_instances") >= 1) & (F.col("unknown_sources") == 0) & (F.col("stale") == 0) & (F.col("unindexed") == 0)
    guarded = joined.where(F.assert_true(F.col("unrecognised") == 0, "corrupt-data: a failure code isn't known").isNull())
    return guarded.withColumn("status", F.when(whole, "complete").otherwise("incomplete")).drop("unrecognised")
