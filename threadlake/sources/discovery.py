"""From a history folder to an indexed library: listing, fingerprints, private copies of databases, and runs.

Files are listed by Spark without their content (path, size, time of change), so an
unchanged conversation's file is never opened. What a conversation is made from has
one digest over all its inputs; a run reads only conversations whose digest isn't
the last good one. After the read the files are listed again: those that changed
meanwhile are read once more by a second discovery, and fail if they still change.

The state databases are files of the machine that holds the histories, the
driver's; they are copied before they are opened, with their write-ahead log.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sqlite3
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import ingest
from threadlake.operators.library import SCHEMAS, Library, empty
from threadlake.operators.service import Writer
from threadlake.sources import blob_store, normal, rollout
from threadlake.sources.snapshots import SourceChanged, private_copy

# Names in the histories' folders, and of the revision scheme.
STATE_FILE, SCHEME = "state_5.sqlite", "sha256-json-v1"
ROLLOUT_NAME = r"^rollout-.*\.jsonl(?:\.zst)?$"
ADAPTER = "1"
_CANDIDATE = ", ".join(f"{c} string" for c in [*C.ID, *ingest.REVISION])


@dataclass(frozen=True)
class RolloutPaths:
    """Where one instance of rollout histories lies, and how its database's folder was chosen."""

    home: str
    database_home: str
    database: str
    chosen_by: str


def rollout_paths(home: str, cwd: str = ".", env: dict[str, str] | None = None) -> RolloutPaths:
    """The folders by configuration file, then environment, then default; the older place of the database counts where the default one has none."""
    env = env or {}
    filled = lambda name: (env.get(name) or "").strip() or None
    root = Path(cwd, filled("CODEX_HOME")) if filled("CODEX_HOME") else Path(home, ".codex")
    configured = _configured(root / "config.toml")
    if configured is not None:
        place, chosen = Path(configured.replace("~", home, 1)) if configured.startswith("~/") else root / configured, "config"
    elif filled("CODEX_SQLITE_HOME"):
        place, chosen = Path(cwd, filled("CODEX_SQLITE_HOME")), "environment"
    else:
        place, chosen = root, "default"
    database, older = place / STATE_FILE, root / "sqlite" / STATE_FILE
    if chosen == "default" and not database.exists() and older.exists():
        database = older
    return RolloutPaths(str(root.resolve()), str(place.resolve()), str(database.resolve()), chosen)


def _configured(file: Path) -> str | None:
    try:
        found = tomllib.loads(file.read_text()).get("sqlite_home")
    except FileNotFoundError:
        return None
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise normal.Malformed("the configuration can't be read") from e
    if found is not None and (not isinstance(found, str) or not found.strip()):
        raise normal.Malformed("sqlite_home isn't a folder's name")
    return found


def probe(spark: SparkSession, path: str) -> str:
    """ready, unavailable (nothing is there) or unreadable."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        files = where.getFileSystem(conf)
        if not files.exists(where):
            return "unavailable"
        files.listStatus(where)
        return "ready"
    except Exception:  # any of the file system's errors says the same
        return "unreadable"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, relative (to folder), bytes, changed_at of every file below folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_extract("path", re.escape(folder.split(":", 1)[-1].lstrip("/").rstrip("/")) + "/(.*)$", 1)
    return files.select("path", inside.alias("relative"), F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("changed_at"))


def aggregated(inputs: DataFrame) -> DataFrame:
    """Candidates of inputs (ID, role, uri, record, print): one digest over a conversation's inputs by role, uri and record.

    It is that of the inputs as JSON lists; normal.fingerprint gives the same of a list of them.
    """
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
    each = F.concat(F.lit("["), F.concat_ws(",", *[quoted(c) for c in ("role", "uri", "record", "print")]), F.lit("]"))
    ordered = F.array_sort(F.collect_list(F.struct("role", "uri", F.coalesce("record", F.lit("")).alias("record"), each.alias("json"))))
    joined = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["json"]), ","), F.lit("]"))
    return inputs.groupBy(*C.ID).agg(F.sha2(joined, 256).alias("digest")).select(*C.ID, F.lit(SCHEME).alias("scheme"), "digest", F.lit(ADAPTER).alias("adapter"))


@dataclass(frozen=True)
class Found:
    """What a discovery found: candidates, failures known without a read (ID, failure_code), heads, and how to read some of them."""

    candidates: DataFrame
    failures: DataFrame
    heads: DataFrame
    read: Callable[[DataFrame], DataFrame]  # ID -> normal.read_documents()


Keep = Callable[[DataFrame], DataFrame]


def run(spark: SparkSession, library: str, kind: str, instance: str, discover: Callable[[Keep], Found], locator: str, at: Callable[[], str], status: str = "ready") -> Library:
    """One run over a source. status: what a probe said; a source that isn't ready infers no absence.

    discover keeps what it lists by the function that it is given, as a listing that is worked out again
    later would tell of other files.
    """
    writer, started = Writer(spark, library), at()
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in C.ID) + ", failure_code string")
    nothing = ingest.Snapshot({n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
    staged: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        staged.append(writer.store.staging())
        df.write.parquet(staged[-1])
        return spark.read.schema(df.schema).parquet(staged[-1])

    try:
        try:
            if status != "ready":
                raise normal.Malformed(status)
            found = discover(keep)
        except (normal.Malformed, SourceChanged, sqlite3.DatabaseError, OSError) as e:
            code = status if status != "ready" else "source-changed" if isinstance(e, SourceChanged) else getattr(e, "code", "unreadable")
            return writer.index(kind, instance, None, nothing, none, started, at(), code)
        stored = writer.store.open() or empty(spark)
        changed = ingest.changes(stored["tracking"], ingest.discovered(found.candidates)).where("status <> 'unchanged'").select(*C.ID)
        wanted = keep(changed.join(found.failures.select(*C.ID), C.ID, "left_anti"))
        read = keep(found.read(wanted))
        # A second discovery: what isn't as it was is read again, as it is now.
        again = discover(keep)
        moved = found.candidates.join(again.candidates, [*C.ID, *ingest.REVISION], "left_anti").select(*C.ID)
        deferred = keep(moved.join(wanted, C.ID, "left_semi"))
        if not deferred.take(1):
            return writer.index_read(kind, instance, found.candidates, read, found.heads, locator, started, at(), found.failures)
        there = deferred.join(again.candidates.select(*C.ID), C.ID, "left_semi")
        reread = keep(again.read(there))
        last = discover(keep)
        steady = there.join(again.candidates, C.ID).join(last.candidates, [*C.ID, *ingest.REVISION], "left_semi").select(*C.ID)
        lost = deferred.join(steady, C.ID, "left_anti").withColumn("failure_code", F.lit("source-changed"))
        whole = read.join(deferred, C.ID, "left_anti").unionByName(reread.join(steady, C.ID, "left_semi"))
        candidates = found.candidates.join(steady, C.ID, "left_anti").unionByName(again.candidates.join(steady, C.ID, "left_semi"))
        heads = again.heads.unionByName(found.heads.join(again.heads.select(*C.ID), C.ID, "left_anti"))
        return writer.index_read(kind, instance, candidates, whole, heads, locator, started, at(), found.failures.unionByName(lost.select(*C.ID, "failure_code")))
    finally:
        for path in staged:
            writer.store.discard(path)


def _identified(df: DataFrame, kind: str, instance: str, native: str) -> DataFrame:
    return df.withColumns({"source_kind": F.lit(kind), "instance_id": F.lit(instance), "native_id": F.col(native)})


def index_rollouts(spark: SparkSession, library: str, paths: RolloutPaths, instance: str, at: Callable[[], str]) -> Library:
    """Indexes what is new of the rollout histories; a file that isn't there fails as unavailable, one of another name as malformed."""

    def discover(keep: Keep) -> Found:
        with private_copy(paths.database) as copy:
            threads, edges, recorded = rollout.threads(spark, copy)
        rows = _identified(threads.where("id <> ''"), "codex", instance, "id")
        name = F.element_at(F.split("rollout_path", "/"), -1)
        # A thread's file may have been packed since its path was noted.
        logical = F.regexp_replace("rollout_path", r"\.zst$", "")
        good = name.rlike(ROLLOUT_NAME) & F.regexp_replace(name, r"\.zst$", "").endswith(F.concat("id", F.lit(".jsonl")))
        files = keep(listed(spark, paths.home)).withColumn("logical", F.regexp_replace("relative", r"\.zst$", ""))
        inside = F.when(logical.startswith("/"), F.replace(logical, F.lit(paths.home + "/"), F.lit(""))).otherwise(logical)
        placed = rows.withColumns({"logical": inside, "good": good}).join(files.select("logical", "path", "relative", "bytes", "changed_at"), "logical", "left")
        one = placed.groupBy(*C.ID, "good", "title", "cwd", "created_at", "updated_at", "logical").agg(F.max(F.struct("changed_at", "bytes", "relative", "path")).alias("f"))
        spawned = edges.groupBy("id").agg(F.to_json(F.array_sort(F.collect_set("parent"))).alias("parents"))
        full = one.join(spawned.withColumnRenamed("id", "native_id"), "native_id", "left")
        row = F.sha2(F.to_json(F.struct("native_id", "title", "cwd", "created_at", "updated_at", "parents")), 256)
        inputs = full.select(*C.ID, F.lit("thread-row").alias("role"), F.lit(STATE_FILE).alias("uri"), F.col("native_id").alias("record"), row.alias("print")).unionByName(
            full.select(*C.ID, F.lit("rollout").alias("role"), F.coalesce("f.relative", "logical").alias("uri"), F.lit(None).cast("string").alias("record"), F.coalesce(F.concat_ws(":", F.col("f.bytes"), F.col("f.changed_at")), F.lit("missing")).alias("print"))
        )
        failures = full.where(~F.col("good") | F.col("f.path").isNull()).select(*C.ID, F.when(F.col("good"), "unavailable").otherwise("malformed").alias("failure_code"))
        heads = full.select(*C.ID, "title", F.col("cwd").alias("workspace"), "created_at", "updated_at")

        def read(wanted: DataFrame) -> DataFrame:
            own = full.join(wanted, C.ID, "left_semi").select(F.col("native_id").alias("id"), F.col("f.path").alias("path"))
            lines = rollout.with_spawns(rollout.lines_of(spark, own, instance), edges)
            return normal.read_documents(lines, rollout.normalise_spawned("complete" if recorded else "unknown"))

        return Found(aggregated(inputs), failures, heads, read)

    status = probe(spark, paths.home)
    status = status if status != "ready" else "ready" if os.path.isfile(paths.database) else "unavailable"
    return run(spark, library, "codex", instance, discover, "rollout:", at, status)


# The catalog's columns.
_AGENT_COLUMNS = ("agent_id", "workspace_ref", "status", "active_run_id", "latest_checkpoint_ref_json", "name", "metadata_json", "created_at", "updated_at")


def catalog_agents(database: str) -> list[tuple[str, str | None, str | None, str, str, str]]:
    """(agent id, checkpoint blob or None, title, created, updated, fingerprint) of a catalog's rows; texts are read as bytes and checked."""
    with private_copy(database) as copy, sqlite3.connect(copy) as db:
        have = [r[1] for r in db.execute("PRAGMA table_info(agents)")]
        if sorted(have) != sorted(_AGENT_COLUMNS):
            raise normal.Unsupported("a catalog has other columns than are known")
        typed = ", ".join(f"typeof({c}), CAST({c} AS BLOB)" for c in _AGENT_COLUMNS)
        rows = db.execute(f"SELECT {typed} FROM agents ORDER BY CAST(agent_id AS BLOB)").fetchall()
    out = []
    for raw in rows:
        row: dict[str, Any] = {}
        for c, kind, value in zip(_AGENT_COLUMNS, raw[::2], raw[1::2]):
            if kind not in ("text", "null"):
                raise normal.Malformed("a catalog's field isn't a text")
            try:
                row[c] = None if kind == "null" else value.decode()
            except UnicodeDecodeError:
                raise normal.Malformed("a catalog's field isn't UTF-8") from None
        identity = normal.string(row, "agent_id", True)
        created, updated = normal.string(row, "created_at"), normal.string(row, "updated_at")
        if updated < created:
            raise normal.Malformed("an agent was updated before it was created")
        normal.mapping(normal.parsed(normal.string(row, "metadata_json")))
        reference = row["latest_checkpoint_ref_json"]
        checkpoint = None
        if reference is not None:
            checkpoint = normal.string(normal.mapping(normal.parsed(reference)), "blobId", True)
            if not re.fullmatch(r"[a-f0-9]{64}", checkpoint):
                raise normal.Malformed("a checkpoint isn't a digest")
        fields = json.dumps([row[c] for c in _AGENT_COLUMNS], ensure_ascii=False, separators=(",", ":"))
        out.append((identity, checkpoint, row["name"], created, updated, hashlib.sha256(fields.encode()).hexdigest()))
    return out


def inventory(files: DataFrame) -> DataFrame:
    """What each file below an agents' folder is: role (chat, catalog, agent, transcript), scope, name, native_id, and its columns.

    Write-ahead logs belong to their database: they are in their row as wal_bytes and wal_changed_at.
    """
    kinds = {
        "chat": r"^chats/([^/]+)/([^/]+)/store\.db$",
        "catalog": r"^projects/([^/]+/sdk-agent-store/[^/]+)/(index)\.db$",
        "agent": r"^projects/([^/]+/sdk-agent-store/[^/]+)/agents/([^/]+)/store\.db$",
        "transcript": r"^projects/([^/]+)/agent-transcripts/.*?([^/]+)\.jsonl$",
    }
    role, scope, name = (F.lit(None).cast("string") for _ in range(3))
    for kind, pattern in kinds.items():
        fits = F.col("relative").rlike(pattern)
        role = F.when(fits, kind).otherwise(role)
        scope = F.when(fits, F.regexp_extract("relative", pattern, 1)).otherwise(scope)
        name = F.when(fits, F.regexp_extract("relative", pattern, 2)).otherwise(name)
    logs = files.where("relative LIKE '%-wal'").select(F.regexp_replace("relative", "-wal$", "").alias("relative"), F.col("bytes").alias("wal_bytes"), F.col("changed_at").alias("wal_changed_at"))
    return files.select("*", role.alias("role"), scope.alias("scope"), name.alias("name")).where("role IS NOT NULL").join(logs, "relative", "left")


def mapped(files: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: native_id, family, scope, path, relative, print, title, created_at, updated_at; issues: kind, about).

    files is inventory(); agents has scope, native_id, checkpoint, title, created_at, updated_at, print. A
    conversation is a chat's store; an agent's store, found by the digest of its id under the catalog's scope; or
    a transcript that neither owns. Agents without a checkpoint own their id but have nothing to read yet.
    """
    state = F.concat_ws(":", "bytes", "changed_at", "wal_bytes", "wal_changed_at")
    chats = files.where("role = 'chat'").select(F.col("name").alias("native_id"), F.lit("chat-store").alias("family"), "scope", "path", "relative", state.alias("print"), *[F.lit(None).cast("string").alias(c) for c in ("title", "created_at", "updated_at")])
    stores = files.where("role = 'agent'").select("scope", F.col("name").alias("folder"), "path", "relative", state.alias("state"))
    owned = agents.where("checkpoint IS NOT NULL").withColumn("folder", F.concat(F.lit("agent-"), F.sha2("native_id", 256)))
    placed = owned.join(stores, ["scope", "folder"], "left")
    ready = placed.where("path IS NOT NULL").select("native_id", F.lit("agent-store").alias("family"), "scope", "path", "relative", F.concat_ws(":", "print", "state").alias("print"), "title", "created_at", "updated_at")
    rich = chats.unionByName(ready)
    owners = rich.select("native_id").unionByName(agents.where("checkpoint IS NULL").select("native_id")).distinct()
    loose = files.where("role = 'transcript'").select(F.col("name").alias("native_id"), F.lit("transcript").alias("family"), "scope", "path", "relative", state.alias("print"), *[F.lit(None).cast("string").alias(c) for c in ("title", "created_at", "updated_at")])
    found = rich.unionByName(loose.join(owners, "native_id", "left_anti"))
    issues = placed.where("path IS NULL").select(F.lit("missing-agent-store").alias("kind"), F.col("native_id").alias("about"))
    twice = found.where("family <> 'transcript'").groupBy("native_id").count().where("count > 1").select(F.lit("duplicate-native-id").alias("kind"), F.col("native_id").alias("about"))
    return found, issues.unionByName(twice)


def outcome(found: DataFrame, issues: DataFrame, transcripts_only_folders: bool = False) -> str:
    """supported, incomplete (something that should be there isn't), unsupported-format or complete-empty."""
    if issues.take(1):
        return "incomplete"
    if found.take(1):
        return "supported"
    return "unsupported-format" if transcripts_only_folders else "complete-empty"


def index_agents(spark: SparkSession, library: str, home: str, instance: str, at: Callable[[], str]) -> Library:
    """Indexes what is new of chat and agent stores and of transcripts below home, a folder that driver and executors share."""

    def discover(keep: Keep) -> Found:
        files = inventory(keep(listed(spark, home)))
        rows = []
        for r in files.where("role = 'catalog'").select("scope", "path").collect():  # one for each project
            rows += [(r["scope"], *a) for a in catalog_agents(re.sub(r"^file:/*", "/", r["path"]))]
        agents = spark.createDataFrame(rows, "scope string, native_id string, checkpoint string, title string, created_at string, updated_at string, print string")
        found, issues = mapped(files, agents)
        state = outcome(found, issues)
        if state == "incomplete":
            raise normal.Malformed("the inventory doesn't agree with the catalogs")
        own = _identified(found, "cursor", instance, "native_id")
        inputs = own.select(*C.ID, F.col("family").alias("role"), F.col("relative").alias("uri"), F.lit(None).cast("string").alias("record"), "print")
        # Two transcripts of one id can't be told apart: neither is read.
        several = own.groupBy(*C.ID).count().where("count > 1").select(*C.ID, F.lit("malformed").alias("failure_code"))
        heads = own.groupBy(*C.ID).agg(F.min("title").alias("title"), F.min("created_at").alias("created_at"), F.min("updated_at").alias("updated_at")).select(*C.ID, "title", F.lit(None).cast("string").alias("workspace"), "created_at", "updated_at")

        def read(wanted: DataFrame) -> DataFrame:
            mine = own.join(wanted, C.ID, "left_semi")
            local = F.regexp_replace("path", "^file:/*", "/")
            stores = mine.where("family <> 'transcript'").select("native_id", local.alias("path"))
            texts = mine.where("family = 'transcript'").select(F.col("native_id").alias("id"), "path")
            told = normal.read_documents(blob_store.store_records(spark, stores, instance), blob_store.normalise_store)
            return told.unionByName(normal.read_documents(rollout.lines_of(spark, texts, instance, "cursor"), blob_store.normalise_transcript))

        return Found(aggregated(inputs), several, heads, read)

    return run(spark, library, "cursor", instance, discover, "store:", at, probe(spark, home))
