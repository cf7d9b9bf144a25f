"""What both file adapters share: drafts of entries, evidence, and the tables they become."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators.ingest import Snapshot


class Malformed(ValueError):
    """The conversation breaks its format's rules; its last good snapshot stays."""

    code = "malformed"


class Unsupported(Malformed):
    """The conversation is of a format version that isn't known."""

    code = "unsupported-format"


#: actor, origin, confidence
HUMAN, MODEL, TOOL, SYSTEM = (("human", "human", "high"), ("model", "model", "high"), ("tool", "tool", "high"), ("system", "system", "high"))
INJECTED, DELEGATED, UNKNOWN = (("system", "injected", "high"), ("model", "delegated", "high"), ("unknown", "unknown", "unknown"))
Evidence = tuple[str, str, str]


@dataclass
class Segment:
    evidence: Evidence
    text: str | None = None
    content_class: str | None = None
    source_type: str | None = None


@dataclass
class Entry:
    kind: str
    evidence: Evidence
    content: list[Segment] = field(default_factory=list)
    timestamp: str | None = None
    record: str = ""
    related: int | None = None
    call_id: str | None = None
    tool: str | None = None
    namespace: str | None = None


@dataclass
class Document:
    entries: list[Entry]
    relations: list[tuple[str, str]] = field(default_factory=list)  # (kind, native id of the target)
    coverage: str = "unknown"


def string(record: dict, name: str, filled: bool = False) -> str:
    value = record.get(name)
    if not isinstance(value, str) or (filled and not value):
        raise Malformed(f"{name} isn't a text")
    try:
        value.encode()
    except UnicodeEncodeError:
        raise Malformed(f"{name} has a lone surrogate") from None
    return value


def optional_string(record: dict, name: str, filled: bool = False) -> str | None:
    return None if record.get(name) is None else string(record, name, filled)


def mapping(value: Any) -> dict:
    if not isinstance(value, dict):
        raise Malformed("an object is missing")
    return value


def sequence(value: Any) -> list:
    if not isinstance(value, list):
        raise Malformed("a list is missing")
    return value


def parsed(line: str) -> Any:
    def once(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise Malformed("a key stands twice")
        return out

    try:
        return json.loads(line, object_pairs_hook=once)
    except json.JSONDecodeError:
        raise Malformed("a record isn't JSON") from None


def fingerprint(inputs: list[tuple[str, str, str | None, str]]) -> str:
    """One digest of all inputs (role, uri, record id, fingerprint) of a conversation."""
    return hashlib.sha256(json.dumps([list(i) for i in inputs], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


ROW = f"{', '.join(f'{c} string' for c in C.ID)}, failure_code string, lineage_coverage string, relations array<struct<relation:string,target:string>>, " + (
    "entries array<struct<ordinal:bigint,entry_kind:string,actor:string,timestamp:string,related_ordinal:bigint,tool_call_id:string,tool_name:string,tool_namespace:string,locator_record:string,"
    "content:array<struct<segment_ordinal:bigint,text:string,content_class:string,source_type:string,origin:string,confidence:string>>>>"
)


def read_documents(records: DataFrame, normalise: Callable[[str, list[str | None]], Document]) -> DataFrame:
    """One nested row for each conversation: its document, or failure_code.

    records: ID, no, line (null: a blank line). A conversation is normalised as a
    whole by one task, as its fold depends on order; conversations are spread over all tasks. What
    it makes is validated there: a document that breaks a rule is malformed.
    """
    from threadlake.sources.validation import validated

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        row: dict[str, Any] = dict(zip(C.ID, key)) | {"failure_code": None, "lineage_coverage": None, "relations": None, "entries": None}
        try:
            lines = frame.sort_values("no")["line"]
            doc = validated(normalise(key[2], [None if pd.isna(x) else x for x in lines]), key[2])
        except Malformed as e:
            return pd.DataFrame([row | {"failure_code": e.code}])
        row |= {"lineage_coverage": doc.coverage, "relations": [{"relation": k, "target": t} for k, t in doc.relations], "entries": list(_entry_rows(doc.entries))}
        return pd.DataFrame([row])

    return records.groupBy(*C.ID).applyInPandas(one, ROW)


def _entry_rows(entries: list[Entry]) -> Iterator[dict]:
    for i, e in enumerate(entries):
        content = [
            {"segment_ordinal": k, "text": s.text, "content_class": s.content_class, "source_type": s.source_type, "origin": s.evidence[1], "confidence": s.evidence[2]}
            for k, s in enumerate(e.content)
        ]
        yield {
            "ordinal": i, "entry_kind": e.kind, "actor": e.evidence[0], "timestamp": e.timestamp, "related_ordinal": e.related, "tool_call_id": e.call_id,
            "tool_name": e.tool, "tool_namespace": e.namespace, "locator_record": e.record, "content": content,
        }


def snapshot(read: DataFrame, heads: DataFrame, locator: str) -> tuple[Snapshot, DataFrame]:
    """Tables of the library from read_documents() and heads (ID, title, workspace, created_at, updated_at); and the failures."""
    good = read.where("failure_code IS NULL")
    entry = good.select(*C.ID, F.explode("entries").alias("e")).select(*C.ID, "e.*")
    segment = entry.select(*C.ID, "ordinal", F.explode("content").alias("s")).select(*C.ID, "ordinal", "s.*")
    digest = F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("digest")
    tables = {
        "documents": good.join(heads, C.ID, "left").select(*C.ID, "lineage_coverage", "title", "workspace", "created_at", "updated_at", F.lit(None).cast("string").alias("document_digest")),
        "relations": good.select(*C.ID, F.posexplode("relations").alias("ordinal", "r")).select(
            *C.ID, F.col("ordinal").cast("long").alias("ordinal"), F.col("r.relation").alias("relation"), F.col("source_kind").alias("target_kind"), F.col("instance_id").alias("target_instance_id"),
            F.col("r.target").alias("target_native_id"), F.lit("high").alias("confidence"),
        ),
        "entries": entry.select(*C.ID, "ordinal", "entry_kind", "actor", "timestamp", "related_ordinal", "tool_call_id", "tool_name", "tool_namespace", F.lit(locator).alias("locator_uri"), "locator_record"),
        "occurrences": segment.select(*C.ID, "ordinal", "segment_ordinal", digest, "content_class", "source_type", "origin", "confidence", F.lit(None).cast("map<string,string>").alias("metadata")),
        "contents": segment.where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "text").distinct(),
    }
    return Snapshot(tables), read.where("failure_code IS NOT NULL").select(*C.ID, "failure_code")
