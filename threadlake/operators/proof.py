"""Reads of a part of a conversation that are proven against what was stored with it.

A conversation's entries are told in blocks of BLOCK; each block has a digest, and one
root covers the header, the relations and all block digests. A window is proven by its
own blocks: they are read whole, told anew, and the list of block digests gives the root.
Texts are proven by their own digests, which the blocks name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import entries as E
from threadlake.operators.library import Library
from threadlake.plans.requests import OperationError

BLOCK = 256
_ENTRY = ("ordinal", "entry_kind", "actor", "timestamp", "related_ordinal", "tool_call_id", "tool_name", "tool_namespace")
_SEGMENT = ("segment_ordinal", "digest", "content_class", "source_type", "origin", "confidence")
_RELATION = ("ordinal", "relation", "target_kind", "target_instance_id", "target_native_id", "confidence")
_HEAD = ("lineage_coverage", "title", "workspace", "created_at", "updated_at", "document_digest")


def _told(rows: Column) -> Column:
    """Structs as one text, by their first field."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.to_json(r)), "\n")


def blocks(library: Library) -> DataFrame:
    """ID, block (from 0) and digest of every block of entries that the library has rows of."""
    segments = library["occurrences"].groupBy(*E.KEY).agg(_told(F.collect_list(F.struct(*_SEGMENT))).alias("segments"))
    told = library["entries"].join(segments, E.KEY, "left").select(*C.ID, F.expr(f"ordinal div {BLOCK}").alias("block"), F.struct(*_ENTRY, "segments").alias("entry"))
    return told.groupBy(*C.ID, "block").agg(F.sha2(_told(F.collect_list("entry")), 256).alias("digest"))


def _heads(library: Library) -> DataFrame:
    """ID, document_digest, relation_count and head_digest: of the header and all relations."""
    relations = library["relations"].groupBy(*C.ID).agg(F.count("*").alias("relation_count"), _told(F.collect_list(F.struct(*_RELATION))).alias("relations"))
    joined = library["documents"].join(relations, C.ID, "left").withColumn("relation_count", F.coalesce("relation_count", F.lit(0)))
    return joined.select(*C.ID, "document_digest", "relation_count", F.sha2(F.to_json(F.struct(*_HEAD, "relations")), 256).alias("head_digest"))


def root(entry_count: Column, head_digest: Column, block_digests: Column) -> Column:
    return F.sha2(F.concat_ws(",", entry_count.cast("string"), head_digest, block_digests), 256)


def roots(library: Library, kept: DataFrame) -> DataFrame:
    """ID, document_digest, entry_count, relation_count, head_digest and root of every document, by its blocks."""
    counts = library["entries"].groupBy(*C.ID).agg(F.count("*").alias("entry_count"))
    listed = kept.groupBy(*C.ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda b: b["digest"]).alias("digests"))
    joined = _heads(library).join(counts, C.ID, "left").join(listed, C.ID, "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
    return joined.select(*C.ID, "document_digest", "entry_count", "relation_count", "head_digest", root(F.col("entry_count"), F.col("head_digest"), F.coalesce("digests", F.array().cast("array<string>"))).alias("root"))


def _corrupt(what: str) -> OperationError:
    return OperationError("corrupt-data", f"{what} of the conversation isn't what was stored")


def proven(own: Library, low: int, high: int) -> Library:
    """The rows of entries low to high, of a library that has one conversation's rows only, after the blocks that hold them were proven.

    Without stored proofs (a library that isn't stored) the rows are taken as they are.
    """
    inside = lambda n, a, b: own[n].where(F.col("ordinal").between(a, b))
    window = own.with_tables(entries=inside("entries", low, high), occurrences=inside("occurrences", low, high))
    kept, top = own.stored("proofs"), own.stored("proof_roots")
    if kept is None or top is None:
        return window
    found, listed = top.collect(), {r["block"]: r["digest"] for r in kept.select("block", "digest").collect()}
    now = _heads(own).select(root(F.lit(found[0]["entry_count"]), F.col("head_digest"), F.array(*[F.lit(listed[b]) for b in sorted(listed)]).cast("array<string>")).alias("root"), "document_digest").collect() if found else []
    if len(found) != 1 or len(now) != 1 or now[0]["root"] != found[0]["root"] or now[0]["document_digest"] != found[0]["document_digest"]:
        raise _corrupt("the header, a relation or a block digest")
    first, last = low // BLOCK, min(high, found[0]["entry_count"] - 1) // BLOCK
    whole = own.with_tables(entries=inside("entries", first * BLOCK, last * BLOCK + BLOCK - 1), occurrences=inside("occurrences", first * BLOCK, last * BLOCK + BLOCK - 1))
    if {r["block"]: r["digest"] for r in blocks(whole).collect()} != {b: listed.get(b) for b in range(first, last + 1)}:
        raise _corrupt("an entry")
    return window


def proven_texts(rows: list) -> None:
    """Raises if a row's text isn't that of its digest."""
    import hashlib

    for r in rows:
        if r["digest"] is not None and (r["text"] is None or hashlib.sha256(r["text"].encode()).hexdigest() != r["digest"]):
            raise _corrupt("a text")
