"""Agent stores: SQLite files with content-addressed blobs, and transcripts as JSON lines.

A store's root blob is a protobuf-like list of message blobs; each message is JSON.
A transcript holds the same conversation in less detail, so where both exist the
store is read. Neither records lineage.
"""

from __future__ import annotations

import hashlib
import json
import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.canonical_json import canonical
from threadlake.sources import normal as N
from threadlake.sources.snapshots import SourceChanged, private_copy

# Fields of a root blob that may stand beside field 1, by wire type.
_BYTES_FIELDS = frozenset((1, 3, 4, 5, 7, 8, 9, 15, 16, 18, 21, 22, 27))
_VARINT_FIELDS = frozenset((10, 26))
_MIME = re.compile(r"[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+\Z", re.I)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of at most 64 bits, seven bits a byte, and where it ends."""
    end = at
    while end < len(data) and data[end] & 0x80:
        end += 1
    if end >= len(data) or end - at > 9:
        raise N.Malformed("a number is cut off or too long")
    value = sum((b & 0x7F) << (7 * k) for k, b in enumerate(data[at : end + 1]))
    if value >= 1 << 64:
        raise N.Malformed("a number is too long")
    return value, end + 1


def root_blob_ids(data: bytes) -> list[str]:
    """The message blobs of a root blob, in order, as hex."""
    out, at = [], 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if not 0 < tag < 1 << 32 or not number:
            raise N.Malformed("a field has no number")
        if wire == 2 and number in _BYTES_FIELDS:
            size, at = _varint(data, at)
            if at + size > len(data) or (number == 1 and size != 32):
                raise N.Malformed("a field is cut off")
            out += [data[at : at + size].hex()] if number == 1 else []
            at += size
        elif wire == 0 and number in _VARINT_FIELDS:
            at = _varint(data, at)[1]
        else:
            raise N.Unsupported("a field isn't known")
    return out


def _only(record, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    found = N.mapping(record)
    if any(k not in found for k in needed) or set(found) - {*needed, *optional}:
        raise N.Unsupported("a record has other fields than are known")
    return found


def read_store(path: str) -> tuple[dict, list[str]]:
    """The head and the messages (JSON texts) of a store file; a private copy of it and of its log is opened."""
    with private_copy(path) as copy, sqlite3.connect(copy) as db:
        rows = db.execute("SELECT value FROM meta WHERE key = '0'").fetchall()
        if len(rows) != 1:
            raise N.Malformed("a store has one head")
        try:
            head = N.mapping(json.loads(bytes.fromhex(rows[0][0])))
        except ValueError:
            raise N.Malformed("a store's head can't be read") from None

        def blob(key: str) -> bytes:
            found = db.execute("SELECT data FROM blobs WHERE id = ?", (key,)).fetchall()
            if len(found) != 1 or not isinstance(found[0][0], bytes):
                raise N.Malformed("a blob is missing")
            return found[0][0]

        try:
            messages = [blob(i).decode() for i in root_blob_ids(blob(N.string(head, "latestRootBlobId", True)))]
        except UnicodeDecodeError:
            raise N.Malformed("a message isn't UTF-8") from None
    return head, messages


def normalise_store(native_id: str, lines: list[str | None]) -> N.Document:
    """One entry for each content item of each message; a result must follow its call, once."""
    out: list[N.Entry] = []
    calls: dict[str, tuple[int, str]] = {}
    answered: set[str] = set()

    def put(kind: str, evidence: N.Evidence, segments: list[N.Segment], record: str, **more) -> int:
        out.append(N.Entry(kind, evidence, segments, record=record, **more))
        return len(out) - 1

    for no, line in enumerate(lines):
        message = _only(N.parsed(line or ""), ("role", "content"), ("id", "providerOptions"))
        role, content = N.string(message, "role", True), message["content"]
        if isinstance(content, str) and role in ("system", "user"):
            evidence = N.SYSTEM if role == "system" else N.HUMAN
            put("message", evidence, [N.Segment(evidence, N.string(message, "content"))], f"{no}:0")
            continue
        if role not in ("user", "assistant", "tool"):
            raise N.Unsupported("a role isn't known")
        for k, item in enumerate(N.sequence(content)):
            kind, at = N.string(N.mapping(item), "type", True), f"{no}:{k}"
            if kind == "text" and role in ("user", "assistant"):
                evidence = N.HUMAN if role == "user" else N.MODEL
                put("message", evidence, [N.Segment(evidence, N.string(_only(item, ("type", "text")), "text"))], at)
            elif kind == "reasoning" and role == "assistant":
                known = _only(item, ("type", "text", "signature", "providerOptions"))
                put("reasoning", N.MODEL, [N.Segment(N.MODEL, N.string(known, "text"))], at)
            elif kind == "redacted-reasoning" and role == "assistant":
                _only(item, ("type", "data", "providerOptions"))
                put("reasoning", N.MODEL, [N.Segment(N.MODEL, content_class="unknown", source_type="redacted-reasoning")], at)
            elif kind == "tool-call" and role == "assistant":
                known = _only(item, ("type", "toolCallId", "toolName", "args"), ("providerOptions",))
                call, name = N.string(known, "toolCallId", True), N.string(known, "toolName", True)
                if call in calls:
                    raise N.Malformed("a call id stands on two calls")
                calls[call] = (put("tool-call", N.MODEL, [N.Segment(N.MODEL, canonical(N.mapping(known["args"])))], at, call_id=call, tool=name), name)
            elif kind == "tool-result" and role == "tool":
                known = _only(item, ("type", "toolCallId", "toolName", "result", "experimental_content"), ("providerOptions",))
                call, name = N.string(known, "toolCallId", True), N.string(known, "toolName", True)
                if calls.get(call, (0, None))[1] != name or call in answered:
                    raise N.Malformed("a result follows no call of its own")
                answered.add(call)
                put("tool-result", N.TOOL, _result(known), at, call_id=call, related=calls[call][0])
            else:
                raise N.Unsupported("a content item isn't known")
    return N.Document(out)


def _result(item: dict) -> list[N.Segment]:
    plain = isinstance(item["result"], str)
    first = N.string(item, "result") if plain else canonical(item["result"])
    out = [N.Segment(N.TOOL, first)]
    for part in N.sequence(item["experimental_content"]):
        kind = N.string(N.mapping(part), "type", True)
        if kind == "text":
            text = N.string(_only(part, ("type", "text")), "text")
            if not (plain and text == first):
                out.append(N.Segment(N.TOOL, text))
        elif kind == "image":
            known = _only(part, ("type", "data", "mimeType"))
            if not _MIME.match(N.string(known, "mimeType", True)):
                raise N.Malformed("an image's type can't be read")
            out.append(N.Segment(N.TOOL, content_class="image", source_type="image"))
        else:
            raise N.Unsupported("a result's part isn't known")
    return out


def normalise_transcript(native_id: str, lines: list[str | None]) -> N.Document:
    """Messages, tool uses and ends of turns of a JSON lines transcript; it has no times."""
    out: list[N.Entry] = []
    ends = {"success": "turn-completed", "error": "turn-error", "aborted": "turn-aborted"}
    for no, line in enumerate(lines):
        record = N.mapping(N.parsed(line or ""))
        if "role" in record:
            role = N.string(_only(record, ("role", "message")), "role", True)
            if role not in ("user", "assistant"):
                raise N.Unsupported("a role isn't known")
            for k, item in enumerate(N.sequence(_only(record["message"], ("content",))["content"])):
                kind = N.string(N.mapping(item), "type", True)
                if kind == "text":
                    evidence = N.HUMAN if role == "user" else N.MODEL
                    out.append(N.Entry("message", evidence, [N.Segment(evidence, N.string(_only(item, ("type", "text")), "text"))], record=f"{no}:{k}"))
                elif kind == "tool_use" and role == "assistant":
                    known = _only(item, ("type", "name", "input"))
                    shown = known["input"] if isinstance(known["input"], str) else canonical(known["input"])
                    out.append(N.Entry("tool-call", N.MODEL, [N.Segment(N.MODEL, shown)], record=f"{no}:{k}", tool=N.string(known, "name", True)))
                else:
                    raise N.Unsupported("a content item isn't known")
        elif record.get("type") == "turn_ended":
            status = N.string(record, "status", True)
            if status not in ends:
                raise N.Unsupported("a turn's end isn't known")
            known = _only(record, ("type", "status") if status == "success" else ("type", "status", "error"))
            said = [] if status == "success" else [N.Segment(N.SYSTEM, N.string(known, "error"))]
            out.append(N.Entry(ends[status], N.SYSTEM, said, record=f"{no}:0"))
        else:
            raise N.Unsupported("a record isn't known")
    return N.Document(out)


def store_name(agent_id: str) -> str:
    """The folder of an agent's store."""
    return "agent-" + hashlib.sha256(agent_id.encode()).hexdigest()


def preferred(stores: DataFrame, transcripts: DataFrame) -> DataFrame:
    """native_id, kind, path of what is read of each conversation: its store, or a transcript that no store owns."""
    rich = stores.select("native_id", F.lit("store").alias("kind"), "path")
    return rich.unionByName(transcripts.join(stores, "native_id", "left_anti").select("native_id", F.lit("transcript").alias("kind"), "path"))


def store_records(spark: SparkSession, stores: DataFrame, instance: str) -> DataFrame:
    """ID, no, line of the messages of stores (native_id, path); files are read where the tasks run, from a folder that all share.

    A store that can't be read gives one line that isn't JSON, so it counts as malformed.
    """

    def messages(batches) -> Iterator:
        import pandas as pd

        for frame in batches:
            out = []
            for native, path in zip(frame["native_id"], frame["path"]):
                try:
                    out += [(native, i, m) for i, m in enumerate(read_store(path)[1])]
                except (N.Malformed, sqlite3.DatabaseError, SourceChanged, OSError):
                    out.append((native, 0, "\x00"))
            yield pd.DataFrame(out, columns=["native_id", "no", "line"])

    read = stores.select("native_id", "path").mapInPandas(messages, "native_id string, no long, line string")
    return read.select(F.lit("cursor").alias("source_kind"), F.lit(instance).alias("instance_id"), "native_id", "no", "line")
