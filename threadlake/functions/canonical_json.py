"""Canonical JSON (RFC 8785) of public documents, and their digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

DIGEST_SCHEME = "sha256-jcs-v1"
#: The two-character escapes of RFC 8785; other control characters are \\u00xx.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _text(s: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def canonical(value: Any) -> str:
    """The one canonical form of None, booleans, safe integers, strings, lists and string-keyed dicts.

    Keys are sorted by UTF-16 code units. Other numbers and lone surrogates are refused.
    """
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        if abs(value) >= 1 << 53:
            raise ValueError("an integer beyond 2^53 has no canonical form")
        return str(value)
    if isinstance(value, str):
        value.encode("utf-8")
        return _text(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{_text(k)}:{canonical(value[k])}" for k in keys) + "}"
    raise ValueError(f"{type(value).__name__} has no canonical form")


def _kept(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    return {k: v for k, v in pairs if v is not None}


def public_document(row: dict[str, Any]) -> dict[str, Any]:
    """What a document shows: neither identity, workspace, locators nor source metadata; absent values are left out."""

    def target(r: dict[str, Any]) -> dict[str, Any]:
        return {"source": {"kind": r["target_kind"], "instanceId": r["target_instance_id"]}, "nativeId": r["target_native_id"]}

    def segment(s: dict[str, Any]) -> dict[str, Any]:
        if s["digest"] is not None:
            body = {"kind": "text", "text": s["text"], "contentHash": s["digest"]}
        else:
            body = {"kind": "omitted", "contentClass": s["content_class"], "sourceType": s["source_type"]}
        return {"ordinal": s["segment_ordinal"], **body, "origin": s["origin"], "originConfidence": s["confidence"]}

    def entry(e: dict[str, Any]) -> dict[str, Any]:
        return _kept(
            [
                ("ordinal", e["ordinal"]), ("kind", e["entry_kind"]), ("actor", e["actor"]), ("timestamp", e["timestamp"]),
                ("relatedEntryOrdinal", e["related_ordinal"]), ("toolCallId", e["tool_call_id"]), ("toolName", e["tool_name"]),
                ("toolNamespace", e["tool_namespace"]), ("content", [segment(s) for s in e["content"] or []]),
            ]
        )

    return _kept(
        [
            ("schemaVersion", 1), ("title", row["title"]), ("createdAt", row["created_at"]), ("updatedAt", row["updated_at"]),
            ("lineageCoverage", row["lineage_coverage"]),
            ("relations", [{"kind": r["relation"], "target": target(r), "confidence": r["confidence"]} for r in row["relations"] or []]),
            ("entries", [entry(e) for e in row["entries"] or []]),
        ]
    )


def digests(nested: DataFrame) -> DataFrame:
    """Identity, document_digest and public_json of nested documents (operators.transcript.nested)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [canonical(public_document(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([hashlib.sha256(m.encode()).hexdigest() for m in made], pa.string()), pa.array(made, pa.string())],
                names=["source_kind", "instance_id", "native_id", "document_digest", "public_json"],
            )

    return nested.mapInArrow(run, "source_kind string, instance_id string, native_id string, document_digest string, public_json string")
