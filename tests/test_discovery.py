import hashlib
import json
import os
import sqlite3

import pytest

from threadlake.operators.library import Store
from threadlake.operators.service import Engine, Writer
from threadlake.plans.requests import SearchRequest
from threadlake.sources import discovery, normal
from threadlake.sources.snapshots import SourceChanged, private_copy

T = [f"2024-01-0{i}T00:00:00.000Z" for i in range(1, 9)]


def said(text):
    return json.dumps({"timestamp": T[0], "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}}) + "\n"


def state(path, threads, edges=()):
    path.unlink(missing_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE threads (id TEXT, rollout_path TEXT, title TEXT, created_at INTEGER)")
        db.executemany("INSERT INTO threads VALUES (?, ?, ?, 1)", threads)
        db.execute("CREATE TABLE thread_spawn_edges (parent_thread_id TEXT, child_thread_id TEXT)")
        db.executemany("INSERT INTO thread_spawn_edges VALUES (?, ?)", edges)


def states(spark, path):
    return {r.native_id: (r.freshness, r.source_state, r.latest_failure) for r in Store(spark, path).open().spine().collect()}


def test_paths_are_configured_then_from_the_environment_then_default(tmp_path):
    home = tmp_path / "me"
    (home / ".codex/sqlite").mkdir(parents=True)
    found = discovery.rollout_paths(str(home))
    assert (found.chosen_by, found.database) == ("default", str(home / ".codex/state_5.sqlite"))
    (home / ".codex/sqlite/state_5.sqlite").touch()
    assert discovery.rollout_paths(str(home)).database == str(home / ".codex/sqlite/state_5.sqlite")
    found = discovery.rollout_paths(str(home), str(tmp_path), {"CODEX_SQLITE_HOME": "db", "CODEX_HOME": " "})
    assert (found.chosen_by, found.database_home) == ("environment", str(tmp_path / "db"))
    (home / ".codex/config.toml").write_text('sqlite_home = "~/other"\n')
    found = discovery.rollout_paths(str(home), str(tmp_path), {"CODEX_SQLITE_HOME": "db"})
    assert (found.chosen_by, found.database) == ("config", str(home / "other/state_5.sqlite"))
    (home / ".codex/config.toml").write_text("sqlite_home = 3\n")
    with pytest.raises(normal.Malformed):
        discovery.rollout_paths(str(home))


def test_a_private_copy_holds_what_the_log_holds(tmp_path):
    live = str(tmp_path / "live.db")
    db = sqlite3.connect(live)
    db.execute("PRAGMA journal_mode = WAL")
    db.execute("PRAGMA wal_autocheckpoint = 0")
    db.execute("CREATE TABLE t (x)")
    db.execute("INSERT INTO t VALUES (1)")
    db.commit()
    before = {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path) if not n.endswith("-shm")}
    with private_copy(live) as copy, sqlite3.connect(copy) as own:
        assert copy != live and own.execute("SELECT x FROM t").fetchall() == [(1,)]
    assert before == {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path) if not n.endswith("-shm")}
    db.close()


def test_a_copy_of_what_keeps_changing_fails(tmp_path, monkeypatch):
    from pathlib import Path

    live, real = tmp_path / "live.db", Path.read_bytes
    live.write_bytes(b"0")

    def changing(self):
        if self == live:
            live.write_bytes(real(live) + b"1")
        return real(self)

    monkeypatch.setattr(Path, "read_bytes", changing)
    with pytest.raises(SourceChanged), private_copy(str(live)):
        pass


def test_digest_of_inputs(spark):
    rows = [("k", "i", "n", "b", "x/é.jsonl", None, "1:2"), ("k", "i", "n", "a", 'q"\\', "r", "p")]
    got = discovery.aggregated(spark.createDataFrame(rows, "source_kind string, instance_id string, native_id string, role string, uri string, record string, print string")).collect()
    assert [r.digest for r in got] == [normal.fingerprint([("a", 'q"\\', "r", "p"), ("b", "x/é.jsonl", None, "1:2")])]


def test_rollouts_from_a_folder(spark, tmp_path, monkeypatch):
    home, path = tmp_path / ".codex", str(tmp_path / "lib")
    (home / "rollouts").mkdir(parents=True)
    at = iter(T * 9)
    paths = discovery.rollout_paths(str(tmp_path))
    run = lambda: discovery.index_rollouts(spark, path, paths, "home", lambda: next(at))
    run()
    assert Store(spark, path).open()["sources"].collect()[0].coverage_status == "unknown"
    file = lambda n: home / f"rollouts/rollout-1-{n}.jsonl"
    for n in "ab":
        file(n).write_text(said(f"first {n}"))
    listed = [("a", "rollouts/rollout-1-a.jsonl", "A"), ("b", str(file("b")), None), ("gone", "rollouts/rollout-1-gone.jsonl", None), ("odd", "rollouts/other.jsonl", None)]
    state(home / "state_5.sqlite", listed, [("a", "b")])
    run()
    assert states(spark, path) == {"a": ("current", "present", None), "b": ("current", "present", None), "gone": ("unindexed", "present", "unavailable"), "odd": ("unindexed", "present", "malformed")}
    lib = Store(spark, path).open()
    assert {r.native_id: (r.title, r.created_at) for r in lib["documents"].collect()} == {"a": ("A", "1970-01-01T00:00:01.000Z"), "b": (None, "1970-01-01T00:00:01.000Z")}
    assert [(r.native_id, r.target_native_id) for r in lib["relations"].collect()] == [("b", "a")]
    # Nothing has changed: no transcript is opened.
    opened = []
    real = discovery.rollout.lines_of
    monkeypatch.setattr(discovery.rollout, "lines_of", lambda s, files, *more: opened.extend(r.id for r in files.collect()) or real(s, files, *more))
    run()
    assert opened == []
    # A file changes while it is read: it is read again as it is then.
    file("a").write_text(said("second a, longer"))
    times = []

    def meanwhile(s, files, *more):
        out = real(s, files, *more)
        if not times:
            out = s.createDataFrame(out.collect(), out.schema)
            file("a").write_text(said("third a, which is longer still"))
        times.append(1)
        return out

    monkeypatch.setattr(discovery.rollout, "lines_of", meanwhile)
    run()
    assert len(times) == 2
    engine = Engine.open(spark, path)
    assert [h["native_id"] for h in engine.search(SearchRequest("third"))["hits"]] == ["a"] and not engine.search(SearchRequest("second"))["hits"]
    assert Writer(spark, path).paths({"codex": str(home), "none": str(tmp_path / "none")})["sources"] == {"codex": "ready", "none": "unavailable"}


def store(folder, messages, agent):
    folder.mkdir(parents=True)
    blobs = {bytes([i + 1] * 32): json.dumps(m).encode() for i, m in enumerate(messages)}
    with sqlite3.connect(folder / "store.db") as db:
        db.execute("CREATE TABLE blobs (id TEXT, data BLOB)")
        db.execute("CREATE TABLE meta (key TEXT, value TEXT)")
        db.executemany("INSERT INTO blobs VALUES (?, ?)", [(k.hex(), v) for k, v in blobs.items()] + [("root", b"".join(b"\x0a\x20" + k for k in blobs))])
        db.execute("INSERT INTO meta VALUES ('0', ?)", (json.dumps({"agentId": agent, "latestRootBlobId": "root"}).encode().hex(),))


def test_agents_from_a_folder(spark, tmp_path):
    home, path = tmp_path / "agents", str(tmp_path / "lib")
    sdk = home / "projects/p/sdk-agent-store/s"
    store(home / "chats/s/chat1", [{"role": "user", "content": "from a chat"}], "chat1")
    store(sdk / "agents" / ("agent-" + hashlib.sha256(b"one").hexdigest()), [{"role": "user", "content": "from an agent"}], "one")
    with sqlite3.connect(sdk / "index.db") as db:
        db.execute("CREATE TABLE agents (agent_id TEXT PRIMARY KEY, workspace_ref TEXT NOT NULL, status TEXT NOT NULL, active_run_id TEXT, latest_checkpoint_ref_json TEXT, name TEXT, metadata_json TEXT NOT NULL DEFAULT '{}', created_at TEXT NOT NULL, updated_at TEXT NOT NULL)")
        checkpoint = json.dumps({"blobId": "a" * 64, "storeKind": "x"})
        db.executemany("INSERT INTO agents VALUES (?, 'w', 'idle', NULL, ?, ?, '{}', ?, ?)", [("one", checkpoint, "Title", T[0], T[1]), ("idle", None, None, T[0], T[0])])
    for n in ("one", "idle", "loose"):
        (home / f"projects/p/agent-transcripts/{n}").mkdir(parents=True)
        (home / f"projects/p/agent-transcripts/{n}/{n}.jsonl").write_text(json.dumps({"role": "assistant", "message": {"content": [{"type": "text", "text": f"from the transcript of {n}"}]}}) + "\n")
    discovery.index_agents(spark, path, str(home), "home", lambda: T[2])
    lib = Store(spark, path).open()
    texts = {r.native_id: r.text for r in lib["occurrences"].join(lib["contents"], "digest").collect()}
    assert texts == {"chat1": "from a chat", "one": "from an agent", "loose": "from the transcript of loose"}
    assert {r.native_id: r.title for r in lib["documents"].collect()}["one"] == "Title"
    # An agent whose store is missing makes the discovery incomplete, so nothing is inferred from it.
    with sqlite3.connect(sdk / "index.db") as db:
        db.execute("INSERT INTO agents VALUES ('lost', 'w', 'idle', NULL, ?, NULL, '{}', ?, ?)", (checkpoint, T[0], T[0]))
    discovery.index_agents(spark, path, str(home), "home", lambda: T[3])
    assert {s for _, s, _ in states(spark, path).values()} == {"unknown"}
    assert discovery.catalog_agents(str(sdk / "index.db"))[1][:2] == ("lost", "a" * 64)


def test_outcomes(spark):
    none = spark.createDataFrame([], "native_id string")
    one = spark.createDataFrame([("a",)], "native_id string")
    assert [discovery.outcome(*x) for x in ((one, none), (none, none), (one, one), (none, none, True))] == ["supported", "complete-empty", "incomplete", "unsupported-format"]
