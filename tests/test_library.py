import json

import pytest

from threadlake.functions import columns as C
from threadlake.operators import doctor, ingest, maintenance, output, search, transcript
from threadlake.operators.library import SCHEMAS, Store
from threadlake.operators.service import Engine, Writer
from threadlake.plans.requests import ListRequest, ManifestRequest, OperationError, SearchRequest, TranscriptRequest
from threadlake.sources import blob_store, normal, rollout

T = [f"2024-01-0{i}T00:00:00.000Z" for i in range(1, 9)]


def line(kind, **payload):
    return json.dumps({"timestamp": T[0], "type": kind, "payload": payload})


def said(text, role="user"):
    return line("response_item", type="message", role=role, content=[{"type": "input_text", "text": text}])


def heard(text):
    return line("event_msg", type="user_message", message=text)


def records(spark, conversations):
    rows = [("codex", "home", n, i, x) for n, lines in conversations.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "source_kind string, instance_id string, native_id string, no long, line string")


def candidates(spark, revisions):
    return spark.createDataFrame([("codex", "home", n, "v1", d, "1") for n, d in revisions.items()], "source_kind string, instance_id string, native_id string, scheme string, digest string, adapter string")


def index(spark, path, conversations, revisions, at, failure=None):
    heads = spark.createDataFrame([], SCHEMAS["documents"]).select(*C.ID, "title", "workspace", "created_at", "updated_at")
    read = normal.read_documents(records(spark, conversations), rollout.normalise)
    return Writer(spark, path).index_read("codex", "home", candidates(spark, revisions) if revisions is not None else None, read, heads, "rollout:", at, at, failure=failure)


def states(spark, path):
    return {r.native_id: (r.freshness, r.source_state) for r in Store(spark, path).open().spine().collect()}


def test_incremental_runs(spark, tmp_path):
    path = str(tmp_path / "lib")
    assert Engine.open(spark, path).list()["conversations"] == []
    with pytest.raises(OperationError):
        Engine.open(spark, path).show(TranscriptRequest(("codex", "home", "a")))
    index(spark, path, {"a": [said("hello"), heard("hello")], "b": [said("hello"), said("more")], "bad": ["{"]}, {"a": "1", "b": "1", "bad": "1"}, T[0])
    assert states(spark, path) == {"a": ("current", "present"), "b": ("current", "present"), "bad": ("unindexed", "present")}
    lib = Store(spark, path).open()
    assert {r.text for r in lib["contents"].collect()} == {"hello", "more"}
    assert [r.n for r in lib["entries"].groupBy("native_id").count().withColumnRenamed("count", "n").orderBy("native_id").collect()] == [1, 2]
    # b changes and fails, a goes missing, c is new; the failed one keeps its document.
    index(spark, path, {"b": ["["], "c": [said("new")], "bad": ["{"]}, {"b": "2", "c": "1", "bad": "1"}, T[1])
    assert states(spark, path) == {"a": ("current", "missing"), "b": ("stale", "present"), "bad": ("unindexed", "present"), "c": ("current", "present")}
    run = Store(spark, path).open()["runs"].orderBy("run_id").collect()[-1]
    assert (run.discovered, run.unchanged, run.indexed, run.failed, run.missing, run.stale) == (3, 0, 1, 2, 1, 1)
    # A failed discovery infers no absence and makes every state unknown.
    index(spark, path, {}, None, T[2], "probe-failed")
    assert {s for _, s in states(spark, path).values()} == {"unknown"}
    index(spark, path, {"b": [said("more"), said("again")], "bad": [said("ok")]}, {"b": "2", "c": "1", "bad": "1"}, T[3])
    assert states(spark, path) == {"a": ("current", "missing"), "b": ("current", "present"), "bad": ("current", "present"), "c": ("current", "present")}
    lib = Store(spark, path).open()
    assert {r.text for r in lib["contents"].collect()} == {"hello", "more", "new", "again", "ok"}
    assert {k: n for k, n in Engine(lib).doctor().items() if n} == {}
    scope = Engine(lib).list(ListRequest())["capture_scope"]
    assert scope["status"] == "complete" and scope["tracked"] == 4 and scope["source_missing"] == 1

    engine = Engine.open(spark, path)
    shown = engine.show(TranscriptRequest(("codex", "home", "b"), full=True))
    assert [e["content"][0]["text"] for e in shown["entries"]] == ["more", "again"]
    with pytest.raises(OperationError, match="no such entry"):
        engine.show(TranscriptRequest(("codex", "home", "b"), entry=5))
    with pytest.raises(OperationError, match="another revision"):
        engine.show(TranscriptRequest(("codex", "home", "b"), expected_digest="0" * 64))
    revisions = engine.manifest(ManifestRequest())["revisions"]
    digest = {r["native_id"]: r["document_digest"] for r in revisions}["b"]
    assert len(digest) == 64 and engine.show(TranscriptRequest(("codex", "home", "b"), full=True, expected_digest=digest))["document_digest"] == digest
    assert [r["native_id"] for r in revisions] == ["a", "b", "bad", "c"]
    for command, result in (("show", shown), ("manifest", engine.manifest()), ("search", engine.search(SearchRequest("again"))), ("list", engine.list())):
        assert json.loads(output.to_json(command, result))["disposition"] == "untrusted-history"
        lines = [json.loads(x) for x in output.to_jsonl(command, result).splitlines()]
        assert lines[0]["schema_version"] == 1 and len(lines) >= 2
        assert "workspace" not in output.to_json(command, result)
        assert output.to_text(command, result)

    writer = Writer(spark, path)
    writer.forget(("codex", "home", "b"))
    lib = Store(spark, path).open()
    assert {r.text for r in lib["contents"].collect()} == {"hello", "new", "ok"} and "b" not in states(spark, path)
    with pytest.raises(OperationError, match="no such conversation"):
        writer.forget(("codex", "home", "b"))
    before = writer.paths()["generation"]
    assert writer.compact() == before and Engine.open(spark, path).library.generation == before + 1
    assert {k: n for k, n in Engine.open(spark, path).doctor(full=True).items() if n} == {}
    writer.store.lock()
    with pytest.raises(OperationError, match="another writer"):
        Writer(spark, path).repair_orphans()
    assert writer.paths()["lock"] == "held"
    writer.store.unlock()
    with pytest.raises(ValueError):
        writer.clear()
    writer.clear(confirmed=True)
    assert Store(spark, path).open() is None


def parts(path):
    """How many parts each table has, by the newest manifest."""
    newest = sorted(path.glob("manifest-*.json"))[-1]
    return {n: len(p) for n, p in json.loads(newest.read_text())["parts"].items()}


def test_commits_write_what_changed(spark, tmp_path):
    """An unchanged run adds no body; changed conversations add parts; a merge leaves one; the index follows all the while."""
    path = str(tmp_path / "lib")
    three = {"a": [said("alpha shared")], "b": [said("beta shared")], "c": [said("gamma")]}
    index(spark, path, three, dict.fromkeys(three, "1"), T[0])
    first = parts(tmp_path / "lib")
    size = lambda: sum(f.stat().st_size for n in ("entries", "contents", "postings") for f in (tmp_path / "lib").rglob(f"{n}/*.parquet"))
    before = size()
    index(spark, path, three, dict.fromkeys(three, "1"), T[1])
    assert size() == before and parts(tmp_path / "lib") == first
    index(spark, path, three | {"a": [said("alpha changed")], "c": [said("shared once more")]}, {"a": "2", "b": "1", "c": "2"}, T[2])
    now = parts(tmp_path / "lib")
    assert now["entries"] == first["entries"] + 1 and now["tracking"] == 1
    engine = Engine.open(spark, path)
    assert {r.text for r in engine.library["contents"].collect()} == {"alpha changed", "beta shared", "shared once more"}
    assert {h["native_id"] for h in engine.search(SearchRequest("shared"))["hits"]} == {"b", "c"} and not engine.search(SearchRequest("gamma"))["hits"]
    # A text that comes back after it was dropped is there again.
    index(spark, path, three | {"c": [said("gamma")]}, {"a": "2", "b": "1", "c": "3"}, T[3])
    engine = Engine.open(spark, path)
    assert [h["native_id"] for h in engine.search(SearchRequest("gamma"))["hits"]] == ["c"] and {k: n for k, n in engine.doctor(full=True).items() if n} == {}


def test_a_query_reads_only_its_own_terms(spark, tmp_path):
    path = str(tmp_path / "lib")
    lib = index(spark, path, {"a": [said("alpha beta")]}, {"a": "1"}, T[0])
    plan = search.phrase_counts(search.index(lib), [["alpha"]])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [alpha])" in plan or "EqualTo(term,alpha)" in plan


@pytest.mark.parametrize("step", ["_write", "_rename"])
def test_a_crash_leaves_the_old_generation(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "lib")
    index(spark, path, {"a": [said("one")]}, {"a": "1"}, T[0])
    before = Store(spark, path).manifest()
    writer, real = Writer(spark, path), getattr(Store, step)

    def crash(self, name, *more):
        if name.startswith("manifest-"):
            raise RuntimeError("lost")
        return real(self, name, *more)

    monkeypatch.setattr(Store, step, crash)
    with pytest.raises(RuntimeError):
        writer.forget(("codex", "home", "a"))
    monkeypatch.undo()
    assert Store(spark, path).manifest() == before and set(states(spark, path)) == {"a"}
    writer.forget(("codex", "home", "a"))
    assert states(spark, path) == {} and Store(spark, path).manifest()["library_id"] == before["library_id"]


def test_locks_pins_and_interrupted_runs(spark, tmp_path):
    path = str(tmp_path / "lib")
    index(spark, path, {"a": [said("one")]}, {"a": "1"}, T[0])
    lost, writer = Store(spark, path), Writer(spark, path)
    # A writer that entered its run and was lost: its lock runs out and the next run ends it.
    lost.lock(seconds=-1)
    lost.commit(ingest.begun(lost.open(), "codex", "home", T[1]))
    lost.renew(seconds=-1)
    assert writer.paths()["lock"] == "expired" and doctor.run_states(lost.open()).collect()[0].active == 1
    writer.store.lock()
    with pytest.raises(OperationError, match="taken over"):
        lost.commit(lost.open())
    lost.unlock()
    assert writer.paths()["lock"] == "held"
    writer.store.unlock()
    index(spark, path, {"a": [said("one")]}, {"a": "1"}, T[2])
    found = doctor.run_states(Store(spark, path).open()).collect()[0]
    assert (found.active, found.interrupted, found.completed) == (0, 1, 2)
    engine = Engine.open(spark, path, pin_seconds=600)
    writer.compact()
    assert len(engine.list()["conversations"]) == 1
    for name in [n for n in writer.store._names() if n.startswith("pin-")]:
        writer.store.unpin(name)
    assert writer.compact() == 2


def test_doctor_finds_what_is_broken(spark, tmp_path):
    path = str(tmp_path / "lib")
    lib = index(spark, path, {"a": [said("hello"), said("x")]}, {"a": "1"}, T[0])
    gone = lib.with_tables(contents=lib["contents"].where("text <> 'x'"))
    assert doctor.foreign_keys(gone).collect()[0].table == "contents"
    assert Engine(gone).doctor()["metrics"] == 1
    holes = lib.with_tables(entries=lib["entries"].where("ordinal > 0"))
    assert {r.issue for r in doctor.documents(holes).collect()} == {"entry-ordinals"}
    orphan = lib.with_tables(occurrences=lib["occurrences"].where("ordinal = 0"))
    counts = maintenance.orphan_counts(orphan).collect()[0]
    assert (counts.orphan_rows, counts.orphan_bytes) == (1, 1)
    digests = transcript.document_digests(lib).collect()
    assert len(digests) == 1 and '"text":"hello"' in digests[0].public_json and "codex" not in digests[0].public_json


def test_discovery_with_two_revisions_fails(spark):
    twice = candidates(spark, {"a": "1"}).unionByName(candidates(spark, {"a": "2"}))
    with pytest.raises(OperationError, match="two revisions"):
        ingest.discovered(twice)
    assert ingest.discovered(candidates(spark, {"a": "1"}).unionByName(candidates(spark, {"a": "1"}))).count() == 1


def test_budget_cuts_whole_code_points(spark):
    texts = ["é" * 10, "abc", "é" * 10, "z"]
    df = spark.createDataFrame([("k", "i", "n", o, t) for o, t in enumerate(texts)], "source_kind string, instance_id string, native_id string, ordinal long, text string")
    got = transcript.budgeted(df, C.ID, ["ordinal"], per_text=7, total=12).orderBy("ordinal").collect()
    assert [r.shown for r in got] == ["ééé", "abc", "é", "z"] and [r.truncated for r in got] == [True, False, True, False]


def fold(families):
    """The fold of neighbouring equal messages, one by one."""
    out = []
    for i, f in enumerate(families):
        if out and out[-1][1] != f:
            out[-1] = (out[-1][0], "response")
        else:
            out.append((i, f))
    return out


def test_adjacent_collapse(spark):
    for families in (["event", "response", "event", "response", "response"], ["response", "event", "event"], ["event", "event"]):
        rows = [("k", "i", "n", o, f, "human", None, "same") for o, f in enumerate(families)]
        df = spark.createDataFrame(rows, "source_kind string, instance_id string, native_id string, ordinal long, family string, actor string, timestamp string, segments string")
        got = sorted((r.ordinal, r.family) for r in ingest.collapse_adjacent(df).collect())
        assert got == fold(families)


def test_rollout_rules():
    doc = rollout.normalise(
        "me",
        [
            line("session_meta", id="me", parent_thread_id="up", base_instructions={"text": "base"}), line("event_msg", type="task_started", turn_id="t"),
            heard("hi"), said("hi"), heard("hi"), None, said("hi"),
            line("response_item", type="function_call", call_id="c", name="read", arguments="{}"), line("response_item", type="function_call_output", call_id="c", output="done"),
            line("event_msg", type="token_count"), line("event_msg", type="odd_thing"), line("turn_context", user_instructions="u"), line("compacted", message="m"),
            line("event_msg", type="task_complete", turn_id="t", error={"message": "oops"}), line("world_state"),
        ],
        spawned_by="up", coverage="complete",
    )
    assert [e.kind for e in doc.entries] == [
        "injected-context", "turn-started", "message", "message", "tool-call", "tool-result", "unknown", "injected-context", "compaction", "injected-context", "turn-completed", "diagnostic",
    ]
    assert doc.entries[5].related == 4 and doc.entries[10].related == 1 and doc.relations == [("parent", "up")]
    assert doc.entries[6].content[0].source_type == "odd-thing"
    call = line("response_item", type="function_call", call_id="c", name="read", arguments="{}")
    for bad in (["{"], ["[]"], [call, call], [line("response_item", type="message", role="robot", content=[])], [line("session_meta", id="me", parent_thread_id="me")], ['{"type":"a","type":"b","payload":{}}']):
        with pytest.raises(normal.Malformed):
            rollout.normalise("me", bad)
    with pytest.raises(normal.Malformed):
        rollout.normalise_spawned("complete")("me", ["\n"])


def test_store_and_transcript(spark, tmp_path):
    import sqlite3

    messages = [
        {"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "q"}]},
        {"role": "assistant", "content": [{"type": "reasoning", "text": "r", "signature": "", "providerOptions": {}}, {"type": "tool-call", "toolCallId": "c", "toolName": "t", "args": {"b": 1, "a": 2}}]},
        {"role": "tool", "content": [{"type": "tool-result", "toolCallId": "c", "toolName": "t", "result": "ok", "experimental_content": [{"type": "text", "text": "ok"}, {"type": "image", "data": "", "mimeType": "image/png"}]}]},
    ]
    raw = [json.dumps(m) for m in messages]
    doc = blob_store.normalise_store("n", raw)
    assert [(e.kind, len(e.content)) for e in doc.entries] == [("message", 1), ("message", 1), ("reasoning", 1), ("tool-call", 1), ("tool-result", 2)]
    assert doc.entries[3].content[0].text == '{"a":2,"b":1}' and doc.entries[4].related == 3
    with pytest.raises(normal.Malformed):
        blob_store.normalise_store("n", [raw[3]])
    with pytest.raises(normal.Unsupported):
        blob_store.normalise_store("n", [json.dumps({"role": "robot", "content": []})])

    blobs = {bytes([i] * 32): r.encode() for i, r in enumerate(raw)}
    root = b"".join(b"\x0a\x20" + k for k in blobs) + b"\x50\x05"
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE blobs (id TEXT, data BLOB)")
        db.execute("CREATE TABLE meta (key TEXT, value TEXT)")
        db.executemany("INSERT INTO blobs VALUES (?, ?)", [(k.hex(), v) for k, v in blobs.items()] + [("root", root)])
        db.execute("INSERT INTO meta VALUES ('0', ?)", (json.dumps({"agentId": "a", "latestRootBlobId": "root"}).encode().hex(),))
    listed = spark.createDataFrame([("a", path), ("gone", str(tmp_path / "none.db"))], "native_id string, path string")
    read = normal.read_documents(blob_store.store_records(spark, listed, "home"), blob_store.normalise_store).collect()
    assert {r.native_id: r.failure_code for r in read} == {"a": None, "gone": "malformed"}
    with pytest.raises(normal.Malformed):
        blob_store.root_blob_ids(b"\x0a\x20abc")
    with pytest.raises(normal.Unsupported):
        blob_store.root_blob_ids(b"\x12\x00")

    lines = [json.dumps({"role": "assistant", "message": {"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "name": "t", "input": {"k": []}}]}}), json.dumps({"type": "turn_ended", "status": "error", "error": "e"})]
    assert [(e.kind, e.content[0].text) for e in blob_store.normalise_transcript("n", lines).entries] == [("message", "x"), ("tool-call", '{"k":[]}'), ("turn-error", "e")]
    stores = spark.createDataFrame([("a", "s")], "native_id string, path string")
    texts = spark.createDataFrame([("a", "t"), ("b", "t")], "native_id string, path string")
    assert sorted((r.native_id, r.kind) for r in blob_store.preferred(stores, texts).collect()) == [("a", "store"), ("b", "transcript")]


def test_rollout_files(spark, tmp_path):
    import sqlite3

    import zstandard

    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.jsonl").write_text(said("plain") + "\n")
    (tmp_path / "f/b.jsonl.zst").write_bytes(zstandard.compress((said("packed") + "\r\n").encode()))
    with sqlite3.connect(tmp_path / "state.db") as db:
        db.execute("CREATE TABLE threads (id TEXT, rollout_path TEXT, title TEXT, created_at INTEGER)")
        db.executemany("INSERT INTO threads VALUES (?, ?, ?, ?)", [("a", "f/a.jsonl", "A", 1), ("b", "f/b.jsonl.zst", None, None)])
        db.execute("CREATE TABLE thread_spawn_edges (parent_thread_id TEXT, child_thread_id TEXT)")
        db.execute("INSERT INTO thread_spawn_edges VALUES ('a', 'b')")
    listed, edges, recorded = rollout.threads(spark, str(tmp_path / "state.db"))
    assert recorded and {r.id: r.created_at for r in listed.collect()} == {"a": "1970-01-01T00:00:01.000Z", "b": None}
    lines = rollout.with_spawns(rollout.records(spark, listed, str(tmp_path / "f"), "home"), edges)
    got = {r.native_id: r for r in normal.read_documents(lines, rollout.normalise_spawned("complete")).collect()}
    assert got["a"].entries[0].content[0].text == "plain" and got["b"].entries[0].content[0].text == "packed"
    assert got["b"].relations[0].target == "a" and got["a"].relations == [] and got["a"].lineage_coverage == "complete"


def test_streaming_folder(spark, tmp_path):
    from threadlake.streaming import drop_folder

    folder, path = str(tmp_path / "drop"), str(tmp_path / "lib")
    follow = lambda: drop_folder.follow(spark, folder, path, "codex", "home", rollout.normalise, str(tmp_path / "check"), lambda: T[0], once=True).awaitTermination()
    records(spark, {"a": [said("one")], "b": [said("two")]}).write.parquet(folder)
    follow()
    records(spark, {"b": [said("two"), said("three")]}).write.mode("append").parquet(folder)
    follow()
    lib = Store(spark, path).open()
    assert {r.text for r in lib["contents"].collect()} == {"one", "two", "three"} and set(states(spark, path).values()) == {("current", "present")}
