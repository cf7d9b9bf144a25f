"""Structured output: one JSON object, or JSON lines with a header, bounded in size; and JSON lines of whole libraries, written by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import entries as E
from threadlake.operators.library import Library
from threadlake.plans.requests import OperationError
from threadlake.sources import shared

SCHEMA_VERSION = 1
LIMIT_BYTES = 16 * 1024 * 1024
DISPOSITION = "untrusted-history"
#: The list of each command's result that becomes one line for each item.
_ITEMS = {"list": "conversations", "search": "hits", "entries": "entries", "manifest": "revisions", "show": "entries", "export": "entries"}
_SINGULAR = {"conversations": "conversation", "hits": "hit", "entries": "entry", "revisions": "revision", "relations": "relation"}


def _shown(value: Any, keep_null: bool = False) -> Any:
    """Absent values are left out, but for next_cursor; a workspace is never shown."""
    if isinstance(value, dict):
        return {k: _shown(v) for k, v in value.items() if k != "workspace" and (v is not None or k == "next_cursor")}
    if isinstance(value, (list, tuple)):
        return [_shown(v) for v in value]
    return value


def _bounded(text: str, full: bool) -> str:
    if not full and len(text.encode()) > LIMIT_BYTES:
        raise OperationError("structured-output-too-large", f"the output is over {LIMIT_BYTES} bytes")
    return text


def to_json(command: str, result: dict, full: bool = False) -> str:
    head = {"schema_version": SCHEMA_VERSION, "command": command, "disposition": DISPOSITION}
    return _bounded(json.dumps(head | _shown(result), indent=2, ensure_ascii=False) + "\n", full)


def _lines(command: str, result: dict) -> Iterator[dict]:
    items = _ITEMS[command]
    shown = _shown(result)
    head = {k: v for k, v in shown.items() if k not in (items, "relations")}
    kind = "conversation" if command in ("show", "export") else "header"
    yield {"schema_version": SCHEMA_VERSION, "command": command, "type": kind, "disposition": DISPOSITION} | head
    reference = {k: shown[k] for k in ("conversation", "document_digest") if command in ("show", "export") and k in shown}
    for name in ("relations", items) if "relations" in shown else (items,):
        for item in shown[name]:
            yield {"type": _SINGULAR[name]} | reference | item


def to_jsonl(command: str, result: dict, full: bool = False) -> str:
    text = "".join(json.dumps(line, ensure_ascii=False, separators=(",", ":")) + "\n" for line in _lines(command, result))
    return _bounded(text, full)


def escaped(text: str) -> str:
    """Text for people: control characters but line feed and tab, and marks that turn text around, as escapes."""
    turning = {*range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x200E, 0x200F, 0x061C}
    return "".join(f"\\u{{{ord(c):x}}}" if (ord(c) < 32 and c not in "\n\t") or 0x7F <= ord(c) < 0xA0 or ord(c) in turning else c for c in text)


def to_text(command: str, result: dict) -> str:
    """A plain rendering for people."""
    out = []
    for item in result[_ITEMS[command]]:
        name = "/".join(str(item[k]) for k in ("source_kind", "instance_id", "native_id") if k in item)
        rest = {k: v for k, v in _shown(item).items() if k not in ("source_kind", "instance_id", "native_id")}
        out.append(f"{name}\n" + "".join(f"  {k}: {v}\n" for k, v in rest.items()))
    return escaped("".join(out))


def documents_as_lines(library: Library) -> DataFrame:
    """ID, part (0: conversation, 1: relation, 2: entry), ordinal and json of every record of every retained conversation, as `export --full` shows them."""
    head = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("export").alias("command"), F.lit("conversation").alias("type"), F.lit(DISPOSITION).alias("disposition"), _name().alias("conversation"), "document_digest", "title", "lineage_coverage", "created_at", "updated_at")
    heads = library["documents"].select(*C.ID, F.lit(0).alias("part"), F.lit(0).cast("long").alias("ordinal"), F.to_json(head).alias("json"))
    digest = library["documents"].select(*C.ID, "document_digest")
    relation = F.struct(F.lit("relation").alias("type"), _name().alias("conversation"), "document_digest", "ordinal", "relation", "target_kind", "target_instance_id", "target_native_id", "confidence")
    relations = library["relations"].join(digest, C.ID).select(*C.ID, F.lit(1).alias("part"), "ordinal", F.to_json(relation).alias("json"))
    texts = library["occurrences"].join(library["contents"], "digest", "left")
    content = texts.groupBy(*E.KEY).agg(F.array_sort(F.collect_list(F.struct("segment_ordinal", "digest", "text", "content_class", "source_type", "origin", "confidence"))).alias("content"))
    entry = F.struct(F.lit("entry").alias("type"), _name().alias("conversation"), "document_digest", "ordinal", "entry_kind", "actor", "timestamp", "related_ordinal", "tool_call_id", "tool_name", "tool_namespace", "content")
    rows = library["entries"].join(content, E.KEY, "left").withColumn("content", F.coalesce("content", F.array()))
    entries = rows.join(digest, C.ID).select(*C.ID, F.lit(2).alias("part"), "ordinal", F.to_json(entry).alias("json"))
    return heads.unionByName(relations).unionByName(entries)


def _name() -> Column:
    return C.printable_identity(F.col("source_kind"), F.col("instance_id"), F.col("native_id"))


_RECORD = '{"record":'


def write_lines(records: DataFrame, order: list[str], path: str, limit: int | None = None) -> tuple[int, int]:
    """Writes json of the records as lines of files in path, in that order over all files, each with its number in `record`; returns how many records and bytes.

    Over so many bytes in all nothing is written. Spark commits the files together, so a
    reader finds all of them or none. What meets on the driver is one row for each range.
    """
    # json is an object, whose opening brace makes room for the number.
    whole = records.select(*order, F.concat(F.lit(","), F.substring("json", F.lit(2), F.char_length("json"))).alias("json"))
    by = [F.asc_nulls_first(c) for c in order]
    cut = shared.saved(whole.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "lines")
    part, seq = F.shiftright("at", 33).alias("part_no"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = cut.groupBy(part).agg(F.count("*").alias("n"), F.sum(F.octet_length("json").cast("long")).alias("bytes")).orderBy("part_no").collect()
    offsets, n, size = [], 0, 0
    for r in counts:
        offsets.append((r["part_no"], n))
        size += r["bytes"] + r["n"] * len(_RECORD + "\n") + sum(len(str(k)) * c for k, c in _by_digits(n, r["n"]))
        n += r["n"]
    if limit is not None and size > limit:
        raise OperationError("structured-output-too-large", f"the output is over {limit} bytes")
    base = F.broadcast(records.sparkSession.createDataFrame(offsets, "part_no long, base long"))  # one row for each range
    numbered = cut.withColumn("part_no", F.shiftright("at", 33)).join(base, "part_no").select((F.col("base") + seq).alias("record"), "json")
    line = F.concat(F.lit(_RECORD), F.col("record").cast("string"), "json")
    numbered.repartitionByRange("record").sortWithinPartitions("record").select(line.alias("value")).write.text(path)
    return n, size


def _by_digits(first: int, n: int) -> Iterator[tuple[int, int]]:
    """For the n numbers from first on: a number of each length, and how many of them there are."""
    while n:
        some = min(n, 10 ** len(str(first)) - first)
        yield first, some
        first, n = first + some, n - some


def export_all(library: Library, path: str) -> tuple[int, int]:
    """Every conversation, whole, as JSON lines: by identity, then header, relations and entries by ordinal."""
    return write_lines(documents_as_lines(library), [*C.ID, "part", "ordinal"], path)
