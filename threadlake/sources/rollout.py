"""Rollout files: one JSON record a line, of outer types that hold messages, tool use, turns and context.

A state database lists the threads (paths, titles, times) and who spawned whom.
Files are read by Spark (plain text; zstd where the name says so), a conversation's
records are folded in order, and the outcome is the canonical model.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.sources import normal as N
from threadlake.sources import records as records_of

# Event types that say nothing about a conversation's content.
SKIPPED = frozenset(
    {
        "realtime_conversation_started", "realtime_conversation_realtime", "realtime_conversation_closed", "realtime_conversation_sdp",
        "model_reroute", "model_verification", "turn_moderation_metadata", "safety_buffering", "thread_settings_applied", "token_count",
        "agent_reasoning_raw_content", "agent_reasoning_section_break", "session_configured", "thread_goal_updated", "mcp_startup_update",
        "mcp_startup_complete", "exec_command_output_delta", "terminal_interaction", "exec_approval_request", "request_permissions",
        "request_user_input", "elicitation_request", "apply_patch_approval_request", "guardian_assessment", "patch_apply_updated", "turn_diff",
        "realtime_conversation_list_voices_response", "plan_update", "shutdown_complete", "raw_response_item", "raw_response_completed",
        "item_started", "hook_started", "hook_completed", "agent_message_content_delta", "plan_delta", "reasoning_content_delta",
        "reasoning_raw_content_delta",
    }
)
_ROLES = {"user": N.HUMAN, "assistant": N.MODEL, "developer": N.INJECTED, "system": N.SYSTEM}
_ABORTS = ("interrupted", "replaced", "review_ended", "budget_limited")
_NAME = re.compile(r"[a-z0-9]+(?:[_-][a-z0-9]+)*\Z")


def source_type(name: str) -> str:
    """A record type as a source type: words joined by hyphens, 64 bytes at most."""
    return name.replace("_", "-") if _NAME.match(name) and len(name) <= 64 else "unknown-record"


def _unknown(name: str) -> N.Entry:
    return N.Entry("unknown", N.UNKNOWN, [N.Segment(N.UNKNOWN, content_class="unknown", source_type=source_type(name))])


def _omitted(evidence: N.Evidence, kind: str, content_class: str = "unknown") -> N.Segment:
    return N.Segment(evidence, content_class=content_class, source_type=kind)


def _item(value, evidence: N.Evidence, texts: tuple[str, ...], encrypted: str | None, other: str) -> N.Segment:
    """A content item: text of the given types, an image, something encrypted, or what isn't known."""
    item = N.mapping(value)
    kind = N.string(item, "type")
    if kind in texts:
        return N.Segment(evidence, N.string(item, "text"))
    if kind == "input_image" and encrypted != "encrypted-agent-content":
        N.string(item, "image_url")
        if item.get("detail") not in (None, "auto", "low", "high", "original"):
            raise N.Malformed("an image's detail isn't known")
        return _omitted(evidence, "input-image", "image")
    if kind == "encrypted_content" and encrypted:
        N.string(item, "encrypted_content")
        return _omitted(evidence, encrypted)
    return _omitted(evidence, "unknown-content-item", other)


class Rollout:
    """Folds the records of one conversation."""

    def __init__(self, native_id: str):
        self.native_id = native_id
        self.entries: list[N.Entry] = []
        self.held: tuple[str, int] | None = None  # family and place of the message before
        self.calls: dict[str, int] = {}
        self.results: dict[str, int] = {}
        self.starts: dict[str, list[int]] = {}
        self.ends: list[tuple[str, int]] = []
        self.lineage: set[tuple[str | None, str | None]] = set()

    def add(self, entry: N.Entry, family: str | None = None) -> int:
        if family and self.held:
            before = self.entries[self.held[1]]
            told = lambda e: (e.kind, e.evidence[0], e.timestamp, e.content)
            if self.held[0] != family and told(before) == told(entry):
                if family == "response":
                    self.entries[self.held[1]] = entry
                self.held = ("response", self.held[1])
                return self.held[1]
        self.entries.append(entry)
        self.held = (family, len(self.entries) - 1) if family else None
        return len(self.entries) - 1

    def record(self, value, no: int) -> None:
        outer = N.mapping(value)
        kind, payload = N.string(outer, "type"), N.mapping(outer.get("payload"))
        self.stamp, self.no = outer.get("timestamp"), str(no)
        if self.stamp is not None:
            N.string(outer, "timestamp")
        handler: Callable[[dict], None] | None = getattr(self, f"_{kind}", None) if kind in _OUTER else None
        if handler:
            handler(payload)
        elif kind not in ("inter_agent_communication_metadata", "world_state"):
            self._put(_unknown(kind))
        else:
            self.held = None

    def _put(self, entry: N.Entry, family: str | None = None) -> int:
        entry.timestamp, entry.record = self.stamp, self.no
        return self.add(entry, family)

    def _note(self, kind: str, evidence: N.Evidence, *segments: N.Segment) -> int:
        return self._put(N.Entry(kind, evidence, list(segments)))

    def _session_meta(self, p: dict) -> None:
        own = N.string(p, "id", True) == self.native_id
        parent, fork = N.optional_string(p, "parent_thread_id", True), N.optional_string(p, "forked_from_id", True)
        base = p.get("base_instructions")
        text = None if base is None else N.string(N.mapping(base), "text")
        self.held = None
        if own:
            self.lineage.add((parent, fork))
            if text is not None:
                self._note("injected-context", N.INJECTED, N.Segment(N.INJECTED, text))

    def _turn_context(self, p: dict) -> None:
        self.held = None
        for name in ("user_instructions", "developer_instructions"):
            text = N.optional_string(p, name)
            if text is not None:
                self._note("injected-context", N.INJECTED, N.Segment(N.INJECTED, text))

    def _compacted(self, p: dict) -> None:
        text = N.string(p, "message")
        self._note("compaction", N.SYSTEM)
        self._note("injected-context", N.INJECTED, N.Segment(N.INJECTED, text))

    def _inter_agent_communication(self, p: dict) -> None:
        N.string(p, "author"), N.string(p, "recipient")
        hidden = [_omitted(N.DELEGATED, "encrypted-agent-content")] if N.optional_string(p, "encrypted_content") is not None else []
        self._note("inter-agent-message", N.DELEGATED, N.Segment(N.DELEGATED, N.string(p, "content")), *hidden)

    def _response_item(self, p: dict) -> None:
        kind = N.string(p, "type")
        if kind == "message":
            evidence = _ROLES.get(N.string(p, "role"))
            if evidence is None or p.get("phase") not in (None, "commentary", "final_answer"):
                raise N.Malformed("a message's role or phase isn't known")
            content = [_item(x, evidence, ("input_text", "output_text"), None, "unknown") for x in N.sequence(p.get("content"))]
            self._put(N.Entry("message", evidence, content), "response")
        elif kind == "agent_message":
            N.string(p, "author"), N.string(p, "recipient")
            self._note("inter-agent-message", N.DELEGATED, *[_item(x, N.DELEGATED, ("input_text",), "encrypted-agent-content", "unknown") for x in N.sequence(p.get("content"))])
        elif kind == "reasoning":
            shown = [_item(x, N.MODEL, ("summary_text",), None, "unknown") for x in N.sequence(p.get("summary"))]
            kept = [N.string(N.mapping(x), "type") in ("reasoning_text", "text") for x in p.get("content") or []]
            shown += [_omitted(N.MODEL, "reasoning-content" if known else "unknown-content-item") for known in kept]
            if N.optional_string(p, "encrypted_content") is not None:
                shown.append(_omitted(N.MODEL, "encrypted-reasoning"))
            self._note("reasoning-summary", N.MODEL, *shown)
        elif kind in ("function_call", "custom_tool_call"):
            self._call(p, "arguments" if kind == "function_call" else "input")
        elif kind in ("function_call_output", "custom_tool_call_output"):
            self._result(p)
        elif kind in ("compaction", "compaction_summary", "context_compaction"):
            hidden = N.optional_string(p, "encrypted_content") if kind == "context_compaction" else N.string(p, "encrypted_content")
            self._note("compaction", N.SYSTEM, *([_omitted(N.SYSTEM, "encrypted-compaction")] if hidden is not None else []))
        elif kind == "compaction_trigger":
            self.held = None
        else:
            self._put(_unknown(kind))

    def _call(self, p: dict, name: str) -> None:
        call = N.string(p, "call_id", True)
        entry = N.Entry("tool-call", N.MODEL, [N.Segment(N.MODEL, N.string(p, name))], call_id=call, tool=N.string(p, "name", True), namespace=N.optional_string(p, "namespace", True))
        if call in self.calls:
            raise N.Malformed("a call id stands on two calls")
        self.calls[call] = self._put(entry)

    def _result(self, p: dict) -> None:
        call, output = N.string(p, "call_id", True), p.get("output")
        if isinstance(output, str):
            content = [N.Segment(N.TOOL, N.string(p, "output"))]
        else:
            content = [_item(x, N.TOOL, ("input_text",), "encrypted-tool-content", "structured") for x in N.sequence(output)]
        if call in self.results:
            raise N.Malformed("a call id stands on two results")
        self.results[call] = self._put(N.Entry("tool-result", N.TOOL, content, call_id=call))

    def _event_msg(self, p: dict) -> None:
        kind = N.string(p, "type")
        texts = {"error": ("message",), "warning": ("message",), "guardian_warning": ("message",), "stream_error": ("message", "additional_details"), "deprecation_notice": ("summary", "details")}
        if kind == "user_message":
            content = [N.Segment(N.HUMAN, N.string(p, "message"))]
            content += [_omitted(N.HUMAN, "input-image", "image") for _ in p.get("images") or []]
            content += [_omitted(N.HUMAN, "local-image", "image") for _ in p.get("local_images") or []]
            self._put(N.Entry("message", N.HUMAN, content), "event")
        elif kind == "agent_message":
            self._put(N.Entry("message", N.MODEL, [N.Segment(N.MODEL, N.string(p, "message"))]), "event")
        elif kind == "agent_reasoning":
            self._note("reasoning-summary", N.MODEL, N.Segment(N.MODEL, N.string(p, "text")))
        elif kind in ("task_started", "turn_started"):
            self.starts.setdefault(N.string(p, "turn_id", True), []).append(self._note("turn-started", N.SYSTEM))
        elif kind in ("task_complete", "turn_complete"):
            turn, error = N.string(p, "turn_id", True), p.get("error")
            said = None if error is None else N.string(N.mapping(error), "message")
            self.ends.append((turn, self._note("turn-completed", N.SYSTEM)))
            if said is not None:
                self._note("diagnostic", N.SYSTEM, N.Segment(N.SYSTEM, said))
        elif kind == "turn_aborted":
            turn = N.optional_string(p, "turn_id", True)
            if N.string(p, "reason") not in _ABORTS:
                raise N.Malformed("a turn's end isn't known")
            at = self._note("turn-aborted", N.SYSTEM)
            if turn is not None:
                self.ends.append((turn, at))
        elif kind == "thread_rolled_back":
            turns = p.get("num_turns")
            if type(turns) is not int or not 0 <= turns < 1 << 32:
                raise N.Malformed("a rollback's turns aren't a number")
            self._note("rollback", N.SYSTEM)
        elif kind == "context_compacted":
            self._note("compaction", N.SYSTEM)
        elif kind in texts:
            first, *more = texts[kind]
            said = [N.string(p, first), *[t for m in more if (t := N.optional_string(p, m)) is not None]]
            self._note("diagnostic", N.SYSTEM, *[N.Segment(N.SYSTEM, t) for t in said])
        elif kind in SKIPPED:
            self.held = None
        else:
            self._put(_unknown(kind))

    def finish(self, spawned_by: str | None, coverage: str) -> N.Document:
        for call, at in self.results.items():
            if call in self.calls:
                self.entries[at].related = self.calls[call]
        for turn, at in self.ends:
            if len(self.starts.get(turn, [])) == 1:
                self.entries[at].related = self.starts[turn][0]
        parents = {p for p, _ in self.lineage if p} | ({spawned_by} if spawned_by else set())
        forks = {f for _, f in self.lineage if f}
        if len(parents) > 1 or len(forks) > 1 or self.native_id in parents | forks:
            raise N.Malformed("the lineage contradicts itself")
        relations = [("parent", p) for p in parents] or [("fork", f) for f in forks]
        return N.Document(self.entries, relations, coverage)


#: Outer types with a method of their own.
_OUTER = frozenset(("session_meta", "turn_context", "response_item", "event_msg", "inter_agent_communication", "compacted"))


def normalise(native_id: str, lines: list[str | None], spawned_by: str | None = None, coverage: str = "unknown") -> N.Document:
    fold = Rollout(native_id)
    for no, line in enumerate(lines):
        if line is None or not line.strip():
            fold.held = None
            continue
        if len(line.encode()) > records_of.RECORD_BYTES:
            raise N.Malformed("a record is too long")
        fold.record(N.parsed(line), no)
    return fold.finish(spawned_by, coverage)


def threads(spark: SparkSession, database: str) -> tuple[DataFrame, DataFrame, bool]:
    """(threads: id, rollout_path, title, cwd, created_at, updated_at; spawn edges: id, parent; whether edges are recorded).

    Older databases lack columns: times in milliseconds are preferred over seconds.
    """
    uri = f"file:{Path(database).as_posix()}?mode=ro"
    with sqlite3.connect(uri, uri=True) as db:
        have = {r[1] for r in db.execute("PRAGMA table_info(threads)")}

        def time(name: str) -> str:
            return f"{name}_ms" if f"{name}_ms" in have else f"{name} * 1000" if name in have else "NULL"

        optional = lambda c: c if c in have else "NULL"
        rows = db.execute(f"SELECT id, rollout_path, {optional('title')}, {optional('cwd')}, {time('created_at')}, {time('updated_at')} FROM threads ORDER BY id").fetchall()
        recorded = bool(db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = 'thread_spawn_edges'").fetchall())
        edges = db.execute("SELECT DISTINCT child_thread_id, parent_thread_id FROM thread_spawn_edges").fetchall() if recorded else []
    listed = spark.createDataFrame(rows, "id string, rollout_path string, title string, cwd string, created long, updated long")
    times = listed.withColumns({"created_at": C.epoch_millis(F.col("created")), "updated_at": C.epoch_millis(F.col("updated"))}).drop("created", "updated")
    return times, spark.createDataFrame(edges, "id string, parent string"), recorded


def lines_of(spark: SparkSession, files: DataFrame, instance: str, kind: str = "codex") -> DataFrame:
    """ID, no, line of the files (id, path): only they are opened, and long ones by many tasks."""
    wanted = files.select("id", "path").distinct().collect()  # names of what changed since the last run
    if not wanted:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in C.ID) + ", no long, line string")
    read = records_of.lines(spark, sorted({r["path"] for r in wanted}))
    return read.join(files.select("id", "path"), "path").select(F.lit(kind).alias("source_kind"), F.lit(instance).alias("instance_id"), F.col("id").alias("native_id"), "no", "line")


def records(spark: SparkSession, listed: DataFrame, folder: str, instance: str) -> DataFrame:
    """ID, no, line of every thread's file under folder (rollout_path is relative to it)."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    same = (name("path") == name("rollout_path")) & F.col("path").endswith(F.col("rollout_path"))
    return lines_of(spark, there.join(listed, same).select("id", "path"), instance)


def with_spawns(recorded: DataFrame, edges: DataFrame) -> DataFrame:
    """The records with one more in front of each spawned conversation's: who spawned it, or a line feed where two claim to."""
    parent = edges.groupBy("id").agg(F.when(F.count_distinct("parent") == 1, F.min("parent")).otherwise("\n").alias("line"))
    heads = recorded.select(*C.ID).distinct().join(parent.withColumnRenamed("id", "native_id"), "native_id", "left")
    return recorded.unionByName(heads.select(*C.ID, F.lit(-1).cast("long").alias("no"), "line"))


def normalise_spawned(coverage: str) -> Callable[[str, list[str | None]], N.Document]:
    """normalise() for records of with_spawns()."""

    def one(native_id: str, lines: list[str | None]) -> N.Document:
        if lines[0] == "\n":
            raise N.Malformed("two conversations claim to have spawned this one")
        return normalise(native_id, lines[1:], lines[0], coverage)

    return one
