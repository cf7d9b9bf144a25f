"""What a document must fulfil before a library takes it."""

from __future__ import annotations

import re

from threadlake.plans.requests import ACTORS, ORIGINS, is_timestamp
from threadlake.sources.normal import Document, Entry, Malformed, Segment

# The other enumerations of the model.
COVERAGES, CONFIDENCES = ("complete", "unknown"), ("high", "medium", "low", "unknown")
RELATIONS, CLASSES = ("parent", "child", "fork", "continuation", "unknown"), ("image", "resource", "structured", "unknown")
_SOURCE_TYPE = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*\Z")


def _segment(s: Segment) -> str | None:
    _, origin, confidence = s.evidence
    if origin not in ORIGINS or confidence not in CONFIDENCES:
        return "evidence"
    omitted = s.content_class is not None or s.source_type is not None
    if (s.text is not None) == omitted:
        return "segment-variant"
    if omitted and (s.content_class not in CLASSES or not s.source_type or len(s.source_type) > 64 or not _SOURCE_TYPE.match(s.source_type)):
        return "segment-type"
    return None if s.text is None or _encodes(s.text) else "lone-surrogate"


def _encodes(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


def _entry(e: Entry, ordinal: int, count: int) -> str | None:
    if not e.kind or e.evidence[0] not in ACTORS:
        return "entry-kind-or-actor"
    if e.timestamp is not None and not is_timestamp(e.timestamp):
        return "timestamp"
    if e.related is not None and (not 0 <= e.related < count or e.related == ordinal):
        return "related-entry"
    if (e.kind != "tool-call" and (e.tool is not None or e.namespace is not None)) or (e.namespace is not None and e.tool is None):
        return "tool-identity"
    if not all(_encodes(x) for x in (e.record, e.call_id, e.tool, e.namespace) if x is not None):
        return "lone-surrogate"
    return next((i for s in e.content if (i := _segment(s))), None)


def issues(doc: Document, native_id: str) -> list[str]:
    """The rules that a document breaks: at most one for each entry, and those of the whole."""
    out = [f"entry {i}: {found}" for i, e in enumerate(doc.entries) if (found := _entry(e, i, len(doc.entries)))]
    if doc.coverage not in COVERAGES:
        out.append("coverage")
    if not native_id or not _encodes(native_id):
        out.append("identity")
    if any(kind not in RELATIONS or not target for kind, target in doc.relations):
        out.append("relation")
    if len(set(doc.relations)) < len(doc.relations):
        out.append("relation-repeated")
    if any(target == native_id for _, target in doc.relations):
        out.append("relation-to-self")
    return out


def validated(doc: Document, native_id: str) -> Document:
    """The document, if it breaks no rule; else its conversation is malformed and its last good document stays."""
    found = issues(doc, native_id)
    if found:
        raise Malformed("; ".join(found[:10]))
    return doc
