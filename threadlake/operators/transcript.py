"""Transcripts of conversations: nested documents, windows, budgets and digest guards."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import canonical_json
from threadlake.functions import columns as C
from threadlake.operators import entries as E
from threadlake.operators import proof
from threadlake.operators.library import Library
from threadlake.plans.requests import OperationError, TranscriptRequest

#: What a bounded transcript shows at most.
ENTRIES, RELATIONS, SEGMENTS, TEXT_BYTES, TOTAL_BYTES = 50, 50, 100, 8 * 1024, 256 * 1024
CONTEXT = 3


def nested(library: Library, identity: tuple[str, str, str] | None = None) -> DataFrame:
    """Whole documents: header, relations[] and entries[] with content[], each by ordinal.

    Arrays hold one conversation's rows; a conversation is the unit of output here.
    """
    pick = lambda df: df if identity is None else df.where(F.struct(*C.ID) == F.struct(*[F.lit(v).alias(c) for c, v in zip(C.ID, identity)]))
    texts = pick(library["occurrences"]).join(library["contents"], "digest", "left")
    segment = F.struct("segment_ordinal", "digest", "text", "content_class", "source_type", "origin", "confidence")
    content = texts.groupBy(*E.KEY).agg(F.array_sort(F.collect_list(segment)).alias("content"))
    entry = F.struct("ordinal", "entry_kind", "actor", "timestamp", "related_ordinal", "tool_call_id", "tool_name", "tool_namespace", "content")
    rows = pick(library["entries"]).join(content, E.KEY, "left").groupBy(*C.ID).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    relation = F.struct("ordinal", "relation", "target_kind", "target_instance_id", "target_native_id", "confidence")
    relations = pick(library["relations"]).groupBy(*C.ID).agg(F.array_sort(F.collect_list(relation)).alias("relations"))
    head = pick(library["documents"]).select(*C.ID, "lineage_coverage", "title", "created_at", "updated_at", F.col("document_digest").alias("stored_digest"))
    return head.join(relations, C.ID, "left").join(rows, C.ID, "left")


def document_digests(library: Library) -> DataFrame:
    return canonical_json.digests(nested(library))


def window(rows: DataFrame, request: TranscriptRequest) -> DataFrame:
    """The entries of a request: around one, a range, the first ones, or all."""
    o = F.col("ordinal")
    if request.entry is not None:
        c = CONTEXT if request.context is None else request.context
        return rows.where(o.between(request.entry - c, request.entry + c))
    if request.from_entry is not None:
        return rows.where(o.between(request.from_entry, request.to_entry))
    return rows if request.full else rows.where(o < ENTRIES)


def budgeted(segments: DataFrame, group: list[str], order: list[str], text: str = "text", per_text: int = TEXT_BYTES, total: int = TOTAL_BYTES, most: int = SEGMENTS) -> DataFrame:
    """The first `most` segments of each group with the bytes that are shown of each text: text_bytes, emitted, shown, truncated.

    A text shows at most per_text bytes and what the earlier ones left of total, in
    whole code points; one without budget stays as an empty text.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group).orderBy(*order)
    first = segments.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    size = lambda s: F.octet_length(s)
    first = first.withColumn("cut", C.truncated_utf8(F.coalesce(F.col(text), F.lit("")), per_text))
    # What a text takes depends on what its predecessors left, code points being whole: a fold over the group's first segments.
    listed = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "cut"))).alias("cuts"))

    def step(state: Column, c: Column) -> Column:
        shown = C.truncated_utf8(c["cut"], F.least(F.lit(per_text), state["left"]))
        return F.struct((state["left"] - size(shown)).alias("left"), F.array_append(state["shown"], shown).alias("shown"))

    start = F.struct(F.lit(total).alias("left"), F.array().cast("array<string>").alias("shown"))
    folded = listed.select(*group, F.posexplode(F.aggregate("cuts", start, step, lambda s: s["shown"])).alias("i", "shown")).withColumn("at", F.col("i") + 1).drop("i")
    out = first.join(folded, [*group, "at"]).withColumns({"text_bytes": size(F.col(text)), "emitted": size(F.col("shown"))})
    return out.withColumn("truncated", F.coalesce(F.col("emitted") < F.col("text_bytes"), F.lit(False))).drop("cut", "at")


def _asked(request: TranscriptRequest, total: int) -> tuple[int, int]:
    """The first and last ordinal that a request shows."""
    if request.entry is not None:
        c = CONTEXT if request.context is None else request.context
        return max(0, request.entry - c), min(total - 1, request.entry + c)
    if request.from_entry is not None:
        return request.from_entry, request.to_entry
    return 0, (total if request.full else min(total, ENTRIES)) - 1


def show(library: Library, request: TranscriptRequest) -> dict:
    """One conversation as a dict: header, digest, relations, entries with content, and what was left out.

    The digest is compared before anything is cut. Of the entries only the blocks that hold
    what is shown are read, and proven against what is stored with the conversation.
    """
    this = F.struct(*C.ID) == F.struct(*[F.lit(v).alias(c) for c, v in zip(C.ID, request.conversation)])
    near = library.near([request.conversation[2]])
    per = ("documents", "relations", "entries", "occurrences", "metrics", "proofs", "proof_roots")
    own = replace(near, tables={n: t.where(this) if n in per else t for n, t in near.tables.items()})
    head = own["documents"].limit(1).collect()
    if not head:
        raise OperationError("conversation-not-found", "the library has no such conversation")
    if request.expected_digest is not None and request.expected_digest != head[0]["document_digest"]:
        raise OperationError("document-digest-mismatch", "the conversation has another revision")
    counts = own.stored("metrics")
    counted = counts.select("entry_count", "relation_count").collect() if counts is not None else []
    total, relations_total = counted[0] if counted else (own["entries"].count(), own["relations"].count())
    wanted = [x for x in (request.entry, request.from_entry, request.to_entry) if x is not None]
    if any(x >= total or x < 0 for x in wanted):
        raise OperationError("entry-not-found", "the conversation has no such entry")
    low, high = _asked(request, total)
    shown = proof.proven(own, low, high)
    entries = [r.asDict() for r in window(shown["entries"], request).orderBy("ordinal").drop(*C.ID, "locator_uri", "locator_record").collect()]
    segments = shown["occurrences"].select(*E.KEY, "segment_ordinal", "digest", "content_class", "source_type", "origin", "confidence").orderBy("ordinal", "segment_ordinal")
    if not request.full:
        segments = segments.limit(SEGMENTS)
    rows = segments.collect()
    digests = sorted({r["digest"] for r in rows if r["digest"] is not None})
    kept = library["contents"]
    kept = kept.where(C.among("digest", digests)) if len(digests) <= SEGMENTS else kept.join(library.spark.createDataFrame([(d,) for d in digests], "digest string"), "digest", "left_semi")
    texts = library.spark.createDataFrame(rows, segments.schema).join(kept, "digest", "left")
    content = texts.collect()
    proof.proven_texts(content)
    if not request.full:
        content = budgeted(library.spark.createDataFrame(content, texts.schema), C.ID, ["ordinal", "segment_ordinal"]).collect()
    by: dict[int, list] = {e["ordinal"]: [] for e in entries}
    for r in sorted(content, key=lambda r: (r["ordinal"], r["segment_ordinal"])):
        s = {k: r[k] for k in ("segment_ordinal", "digest", "text", "content_class", "source_type", "origin", "confidence")}
        if not request.full and s["text"] is not None:
            s |= {"text": r["shown"], "truncated": r["truncated"]}
        by[r["ordinal"]].append(s)
    relations = own["relations"].orderBy("ordinal")
    relations = [r.asDict() for r in (relations if request.full else relations.limit(RELATIONS)).drop(*C.ID).collect()]
    title = head[0]["title"] if request.full or head[0]["title"] is None else shortened(head[0]["title"], TEXT_BYTES)
    return {
        "conversation": printable(request.conversation),
        "document_digest": head[0]["document_digest"],
        "title": title,
        "relations": relations,
        "entries": [e | {"content": by[e["ordinal"]]} for e in entries],
        "selection": {"total_entries": total, "emitted_entries": len(entries), "omitted_entries": total - len(entries), "omitted_relations": relations_total - len(relations)},
    }


def shortened(text: str, most: int) -> str:
    """The longest prefix of whole code points within so many UTF-8 bytes."""
    return text.encode()[:most].decode(errors="ignore") if len(text.encode()) > most else text


def printable(identity: tuple[str, str, str]) -> str:
    from urllib.parse import quote

    kind, instance, native = identity
    return f"{kind}@{quote(instance, safe='')}:{quote(native, safe='')}"
