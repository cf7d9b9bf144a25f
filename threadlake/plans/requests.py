"""Query objects: a request that exists is valid. Their limits are the engine's contract."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, fields
from datetime import datetime

# Who speaks, where a text comes from, what a source says about a conversation; and the limits of requests.
ACTORS = ("human", "model", "tool", "system", "unknown")
ORIGINS = ("human", "injected", "delegated", "replayed-copied", "model", "tool", "system", "unknown")
STATES = ("present", "missing", "unknown")
MAX_TERMS, MAX_TEXT_BYTES, MAX_LIMIT, MAX_CONTEXT, MAX_CURSOR = 32, 4096, 200, 10, 2048
MANIFEST_LIMIT = 10_000
# The code points of Unicode White_Space, which separates search terms.
_WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACES = re.compile("[" + "".join(map(chr, _WHITE_SPACE)) + "]+")
_KIND = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*\Z")
_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\Z")


class UsageError(ValueError):
    """A request that can't be valid (exit code 2): code says why."""

    exit_code = 2

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class OperationError(RuntimeError):
    """A valid request that the library can't answer now (exit code 1)."""

    exit_code = 1

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _within(name: str, value: int, low: int, high: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise UsageError("invalid-value", f"{name} must be an integer from {low} to {high}")


def is_timestamp(text: str) -> bool:
    if not _STAMP.match(text):
        return False
    try:
        datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ")
    except ValueError:
        return False
    return True


@dataclass(frozen=True)
class ConversationFilter:
    """Exact values, and bounds that exclude their ends; a null time is within no bound."""

    source: str | None = None
    instance: str | None = None
    native_id: str | None = None
    source_state: str | None = None
    workspace: str | None = None
    activity_after: str | None = None
    activity_before: str | None = None
    captured_after: str | None = None
    captured_before: str | None = None
    observed_after: str | None = None
    observed_before: str | None = None
    conversation: tuple[str, str, str] | None = None

    def __post_init__(self) -> None:
        if self.instance is not None and self.source is None:
            raise UsageError("invalid-value", "an instance needs a source")
        if self.source is not None and not _KIND.match(self.source):
            raise UsageError("invalid-value", "a source kind is lower-case words joined by hyphens")
        if self.source_state is not None and self.source_state not in STATES:
            raise UsageError("invalid-value", f"source_state is one of {STATES}")
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and f.name.endswith(("_after", "_before")) and not is_timestamp(value):
                raise UsageError("invalid-value", f"{f.name} isn't a canonical timestamp")
            if value == "":
                raise UsageError("invalid-value", f"{f.name} is empty")
        for f in fields(self):
            if f.name.endswith("_after"):
                after, before = getattr(self, f.name), getattr(self, f.name.replace("_after", "_before"))
                if after is not None and before is not None and after >= before:
                    raise UsageError("invalid-value", f"{f.name} must be before its other bound")


@dataclass(frozen=True)
class EntryFilter(ConversationFilter):
    entry_after: str | None = None
    entry_before: str | None = None
    actor: str | None = None
    origin: str | None = None
    entry_kind: str | None = None
    tool_name: str | None = None
    tool_namespace: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.actor is not None and self.actor not in ACTORS:
            raise UsageError("invalid-value", f"actor is one of {ACTORS}")
        if self.origin is not None and self.origin not in ORIGINS:
            raise UsageError("invalid-value", f"origin is one of {ORIGINS}")


#: Filters that the capture scope is narrowed by; any other that is set is disclosed as unassessed.
ASSESSED = ("source", "instance", "native_id", "source_state", "conversation")


def disclosed(f: ConversationFilter) -> tuple[list[str], list[str]]:
    """Names of the filters that a capture scope applies, and of those that it doesn't assess."""
    used = [x.name for x in fields(f) if getattr(f, x.name) is not None]
    return [n for n in used if n in ASSESSED], [n for n in used if n not in ASSESSED]


@dataclass(frozen=True)
class ListRequest:
    filter: ConversationFilter = ConversationFilter()
    limit: int = 50
    cursor: str | None = None

    def __post_init__(self) -> None:
        _within("limit", self.limit, 1, MAX_LIMIT)
        _cursor_size(self.cursor)


@dataclass(frozen=True)
class EntriesRequest:
    filter: EntryFilter = EntryFilter()
    selection: str = "all"
    limit: int = 50
    cursor: str | None = None

    def __post_init__(self) -> None:
        _within("limit", self.limit, 1, MAX_LIMIT)
        _cursor_size(self.cursor)
        if self.selection not in ("all", "first", "last"):
            raise UsageError("invalid-value", "selection is all, first or last")


@dataclass(frozen=True)
class SearchRequest:
    text: str
    mode: str = "all"
    filter: EntryFilter = EntryFilter()
    limit: int = 20
    context: int = 0
    cursor: str | None = None

    def __post_init__(self) -> None:
        _within("limit", self.limit, 1, MAX_LIMIT)
        _within("context", self.context, 0, MAX_CONTEXT)
        _cursor_size(self.cursor)
        if self.mode not in ("all", "any"):
            raise UsageError("invalid-value", "mode is all or any")
        terms = search_terms(self.text)
        if not terms:
            raise UsageError("invalid-value", "a search needs a term")
        if len(terms) > MAX_TERMS or len(" ".join(terms).encode()) > MAX_TEXT_BYTES:
            raise UsageError("invalid-value", f"a search takes {MAX_TERMS} terms and {MAX_TEXT_BYTES} bytes at most")


@dataclass(frozen=True)
class ManifestRequest:
    filter: ConversationFilter = ConversationFilter()

    def __post_init__(self) -> None:
        if self.filter.workspace is not None:
            raise UsageError("invalid-value", "a manifest isn't filtered by workspace")


@dataclass(frozen=True)
class TranscriptRequest:
    """Part of one conversation: around an entry, a range of entries, the first entries, or all of it (full)."""

    conversation: tuple[str, str, str]
    expected_digest: str | None = None
    entry: int | None = None
    context: int | None = None
    from_entry: int | None = None
    to_entry: int | None = None
    full: bool = False

    def __post_init__(self) -> None:
        ranged = self.from_entry is not None or self.to_entry is not None
        if (self.entry is not None) + ranged + self.full > 1:
            raise UsageError("invalid-value", "choose an entry, a range or everything")
        if self.context is not None and self.entry is None:
            raise UsageError("invalid-value", "context needs an entry")
        if self.context is not None:
            _within("context", self.context, 0, 100)
        if ranged:
            if self.from_entry is None or self.to_entry is None or not 0 <= self.from_entry <= self.to_entry:
                raise UsageError("invalid-value", "a range needs both ends, in order")
            if self.to_entry - self.from_entry + 1 > 200:
                raise UsageError("invalid-value", "a range has 200 entries at most")


def _cursor_size(cursor: str | None) -> None:
    if cursor is not None and not 0 < len(cursor) <= MAX_CURSOR:
        raise UsageError("invalid-cursor", f"a cursor has 1 to {MAX_CURSOR} characters")


def search_terms(text: str) -> list[str]:
    """The terms of a search in order; repeats stay, as they count in ranking."""
    return [t for t in _SPACES.split(text) if t]


def fingerprint(request: ListRequest | EntriesRequest | SearchRequest) -> str:
    """What a cursor belongs to: everything about a request but its cursor and page size."""
    shown = {k: v for k, v in asdict(request).items() if k not in ("cursor", "limit")}
    if isinstance(request, SearchRequest):
        shown["text"] = " ".join(search_terms(request.text))
    material = [type(request).__name__, json.dumps(shown, sort_keys=True, ensure_ascii=False)]
    return hashlib.sha256(json.dumps(material, ensure_ascii=False).encode()).hexdigest()
