"""Page cursors: base64url JSON that binds a position to a query, a library and a generation."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from threadlake.plans.requests import OperationError, UsageError

_FIELDS = ("v", "q", "l", "g")


@dataclass(frozen=True)
class Position:
    """Where the next page starts: after a key (list, entries) or at an offset (search)."""

    after: tuple | None = None
    offset: int = 0


def encode(query: str, library: str, generation: int, position: Position) -> str:
    body = {"v": 2, "q": query, "l": library, "g": generation, "o": position.offset}
    if position.after is not None:
        body["s"] = list(position.after)
    raw = json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode(cursor: str, query: str, library: str, generation: int) -> Position:
    """invalid and mismatch are usage errors and tested first; a cursor of an older generation is stale."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError:
        raise UsageError("invalid-cursor", "the cursor can't be read") from None
    if not isinstance(body, dict) or any(k not in body for k in _FIELDS) or body["v"] not in (1, 2):
        raise UsageError("invalid-cursor", "the cursor can't be read")
    offset, after = body.get("o", 0), body.get("s")
    if type(offset) is not int or offset < 0 or type(body["g"]) is not int or not (after is None or isinstance(after, list)):
        raise UsageError("invalid-cursor", "the cursor can't be read")
    if body["q"] != query or body["l"] != library:
        raise UsageError("cursor-mismatch", "the cursor belongs to another query or library")
    if body["g"] != generation:
        raise OperationError("stale-cursor", "the library has changed since the cursor was made")
    return Position(tuple(after) if after is not None else None, offset)
