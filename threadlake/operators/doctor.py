"""Health checks: each returns rows that break a rule, so a healthy library gives none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import listing, maintenance, proof, search, transcript
from threadlake.operators.library import Library
from threadlake.operators.scope import FAILURES


def foreign_keys(library: Library) -> DataFrame:
    """Rows whose parent row is missing: table and number of rows."""
    docs = library["documents"].select(*C.ID)
    entry = library["entries"].select(*C.ID, "ordinal")
    content = library["contents"].select("digest")
    broken = [
        ("tracking", library["tracking"].join(library["sources"], ["source_kind", "instance_id"], "left_anti")),
        ("documents", docs.join(library["tracking"], C.ID, "left_anti")),
        ("relations", library["relations"].join(docs, C.ID, "left_anti")),
        ("entries", library["entries"].join(docs, C.ID, "left_anti")),
        ("occurrences", library["occurrences"].join(entry, [*C.ID, "ordinal"], "left_anti")),
        ("contents", library["occurrences"].where("digest IS NOT NULL").join(content, "digest", "left_anti")),
    ]
    out = None
    for name, rows in broken:
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out.where("rows > 0")


def documents(library: Library) -> DataFrame:
    """Documents that break a rule, with its name."""
    e, o = library["entries"], library["occurrences"]
    per = e.groupBy(*C.ID).agg(F.count("*").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_if((F.col("related_ordinal") == F.col("ordinal")) | (F.col("related_ordinal") < 0)).alias("bad_related"), F.max("related_ordinal").alias("far"))
    entry_rules = per.select(*C.ID, F.array_compact(F.array(F.when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1), "entry-ordinals"), F.when((F.col("bad_related") > 0) | (F.col("far") >= F.col("n")), "related-entry"))).alias("issues"))
    seg = o.groupBy(*C.ID, "ordinal").agg(F.count("*").alias("n"), F.min("segment_ordinal").alias("low"), F.max("segment_ordinal").alias("high"))
    segments = seg.where("low <> 0 OR high <> n - 1").select(*C.ID, F.array(F.lit("segment-ordinals")).alias("issues"))
    variants = o.where(F.col("digest").isNotNull() == (F.col("content_class").isNotNull() | F.col("source_type").isNotNull())).select(*C.ID, F.array(F.lit("segment-variant")).alias("issues"))
    tools = e.where("(tool_name IS NOT NULL AND entry_kind <> 'tool-call') OR (tool_namespace IS NOT NULL AND tool_name IS NULL)").select(*C.ID, F.array(F.lit("tool-fields")).alias("issues"))
    times = e.where(~C.is_canonical_timestamp(F.col("timestamp"))).select(*C.ID, F.array(F.lit("timestamp")).alias("issues"))
    r = library["relations"]
    target = F.struct("target_kind", "target_instance_id", "target_native_id")
    twice = r.groupBy(*C.ID, "relation", target.alias("target")).count().where("count > 1").select(*C.ID, F.array(F.lit("relation-repeated")).alias("issues"))
    own = r.where((F.col("target_kind") == F.col("source_kind")) & (F.col("target_instance_id") == F.col("instance_id")) & (F.col("target_native_id") == F.col("native_id"))).select(*C.ID, F.array(F.lit("relation-to-self")).alias("issues"))
    out = entry_rules
    for part in (segments, variants, tools, times, twice, own):
        out = out.unionByName(part)
    return out.select(*C.ID, F.explode("issues").alias("issue")).distinct()


def contents(library: Library) -> DataFrame:
    """Contents whose digest isn't that of their text."""
    return library["contents"].where(F.sha2("text", 256) != F.col("digest")).select("digest")


def digests(library: Library) -> DataFrame:
    """Documents whose stored digest isn't that of their public form."""
    found = transcript.document_digests(library).select(*C.ID, F.col("document_digest").alias("computed"))
    return library["documents"].join(found, C.ID, "left").where(~F.col("document_digest").eqNullSafe(F.col("computed"))).select(*C.ID, "document_digest", "computed")


def runs(library: Library) -> DataFrame:
    """Runs whose counts don't agree with each other or with their items, or whose times don't fit their status."""
    items = library["run_items"].groupBy("run_id").agg(F.count("*").alias("items"))
    r = library["runs"].join(items, "run_id", "left").fillna(0, ["items"])
    bad = (F.col("discovered") != F.col("unchanged") + F.col("indexed") + F.col("failed")) | (F.col("stale") > F.col("failed")) | (F.col("failed") + F.col("missing") != F.col("items") + F.col("omitted_items"))
    open_ = F.col("status") == "active"
    return r.where(((F.col("status") == "completed") & bad) | (open_ != F.col("finished_at").isNull()) | (~open_ & (F.col("finished_at") < F.col("started_at")))).select("run_id")


def run_states(library: Library) -> DataFrame:
    """One row: how many runs are active, interrupted, failed and completed."""
    states = ("active", "interrupted", "failed", "completed")
    return library["runs"].agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def failure_codes(library: Library) -> DataFrame:
    return library["tracking"].where(F.col("latest_failure").isNotNull() & ~F.col("latest_failure").isin(*FAILURES)).select(*C.ID, "latest_failure")


def text_index(library: Library, stored: DataFrame | None = None) -> DataFrame:
    """Where stored postings and those of the contents differ (term, digest, length, positions, side); terms by ranges, of which equal ones are never shuffled."""
    columns = ["term", "digest", "length", "positions"]
    made = search.postings(library["contents"]).select(columns)
    kept = library.stored("postings") if stored is None else stored
    return maintenance.difference(made, made if kept is None else kept.select(columns), "term")


def vocabulary(library: Library) -> DataFrame:
    """Terms of which the stored index counts other texts or instances than the contents have."""
    made, kept = search.postings(library["contents"]), library.stored("postings")
    return search.vocabulary_difference(made, made if kept is None else kept)


def index_coverage(library: Library) -> DataFrame:
    """Contents whose length isn't stored, and stored lengths without a content or with another number of tokens: digest, side."""
    made, kept = search.lengths(library["contents"]), library.stored("lengths")
    return maintenance.difference(made, made if kept is None else kept, "digest").select("digest", "side")


def proofs(library: Library) -> DataFrame:
    """Blocks of entries whose stored digest isn't that of their rows."""
    made, kept = proof.blocks(library), library.stored("proofs")
    return maintenance.difference(made, made if kept is None else kept.select(made.columns), "native_id").select(*C.ID, "block").distinct()


def metrics(library: Library) -> DataFrame:
    """Documents whose stored metrics aren't those of their rows, or that refer to a text that isn't there."""
    made, kept = listing.computed_metrics(library), library.stored("metrics")
    broken = made.where("text_bytes < 0").select(*C.ID)
    return broken if kept is None else broken.unionByName(maintenance.difference(made, kept.select(made.columns), "native_id").select(*C.ID)).distinct()


CHECKS: dict[str, Callable[[Library], DataFrame]] = {
    "foreign-keys": foreign_keys,
    "documents": documents,
    "contents": contents,
    "orphans": maintenance.orphans,
    "metrics": metrics,
    "runs": runs,
    "failure-codes": failure_codes,
}


def diagnose(library: Library, full: bool = False) -> DataFrame:
    """check, broken: the number of rows that break each check's rule; full also recomputes every document's digest and the text index."""
    checks = CHECKS | ({"digests": digests, "text-index": text_index, "vocabulary": vocabulary, "index-coverage": index_coverage, "proofs": proofs} if full else {})
    out = None
    for name, check in checks.items():
        one = check(library).agg(F.count("*").alias("broken")).select(F.lit(name).alias("check"), "broken")
        out = one if out is None else out.unionByName(one)
    return out
