"""The library: canonical tables of one generation, and their storage.

A stored library is a folder of numbered manifests and of Parquet parts. A manifest
names the parts of every table of its generation; the newest manifest is the
library. A writer adds parts and then the next manifest, by a rename that fails
where one of that number is there, so a crash at any point leaves the old or the
new generation and readers see one of them, never a mixture.

A commit writes what changed: rows of new or changed conversations and texts are
further parts, and those that go are named by tombstones, which hold for parts of
earlier generations. A run in which nothing changed writes a few rows of tracking.
Derived tables are kept in step: postings and lengths of texts, metrics of
documents, roots of conversations. Compaction writes all parts of a table as one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.plans.requests import OperationError
from threadlake.sources import shared

SCHEMA_VERSION = 3
_ID = "source_kind string, instance_id string, native_id string"
SCHEMAS = {
    "sources": "source_kind string, instance_id string, coverage_status string, coverage_observed_at string",
    "tracking": f"{_ID}, last_good_scheme string, last_good_digest string, last_good_adapter string, latest_scheme string, latest_digest string, latest_adapter string,"
    " latest_outcome string, latest_failure string, presence_status string, presence_observed_at string, captured_at string, last_seen_at string",
    "documents": f"{_ID}, lineage_coverage string, title string, workspace string, created_at string, updated_at string, document_digest string",
    "relations": f"{_ID}, ordinal long, relation string, target_kind string, target_instance_id string, target_native_id string, confidence string",
    "entries": f"{_ID}, ordinal long, entry_kind string, actor string, timestamp string, related_ordinal long, tool_call_id string, tool_name string, tool_namespace string,"
    " locator_uri string, locator_record string",
    "occurrences": f"{_ID}, ordinal long, segment_ordinal long, digest string, content_class string, source_type string, origin string, confidence string, metadata map<string,string>",
    "contents": "digest string, text string",
    "runs": "run_id long, source_kind string, instance_id string, status string, started_at string, finished_at string, failure_code string,"
    " discovered long, unchanged long, indexed long, failed long, missing long, stale long, omitted_items long",
    "run_items": f"run_id long, item long, {_ID}, outcome string, failure_code string",
}


#: What follows from the other tables and is stored beside them.
DERIVED = {
    "metrics": f"{_ID}, relation_count long, entry_count long, segment_count long, omitted_count long, text_bytes long",
    "roots": f"{_ID}, root struct<source_kind:string,instance_id:string,native_id:string>",
    "postings": "term string, block int, digest string, length long, positions array<int>",
    "blocks": "term string, block int, texts long, most int, least long",
    "lengths": "digest string, length long",
    "corpus": "texts long, tokens long",
    "places": f"digest string, {_ID}, ordinal long, segment_ordinal long, origin string",
    "proofs": f"{_ID}, block long, digest string",
    "proof_roots": f"{_ID}, document_digest string, entry_count long, relation_count long, head_digest string, root string",
}
#: The tables that a derived one follows from.
_SOURCES_OF = {"metrics": ("documents", "relations", "entries", "occurrences", "contents"), "roots": ("documents", "relations"), "postings": ("contents",), "blocks": ("contents",), "lengths": ("contents",), "corpus": ("contents",), "places": ("occurrences",)}
_SOURCES_OF |= dict.fromkeys(("proofs", "proof_roots"), ("documents", "relations", "entries", "occurrences"))
BY_CONVERSATION = ("documents", "relations", "entries", "occurrences", "metrics", "places", "proofs", "proof_roots")
BY_TEXT = ("contents", "postings", "lengths")
#: Tables of which a query reads a few keys' rows, and the order that they are cut into files and sorted by.
BY_KEY = {
    "documents": C.ID, "relations": [*C.ID, "ordinal"], "entries": [*C.ID, "ordinal"], "occurrences": [*C.ID, "ordinal", "segment_ordinal"], "contents": ["digest"], "proofs": [*C.ID, "block"], "proof_roots": C.ID,
    "postings": ["term", "block"], "blocks": ["term", "block"], "places": ["digest", *C.ID, "ordinal"],
}
#: Those of them whose files are as the step that makes them left them, each sorted (blocks as the postings are that they are made of): ranges are drawn by making all rows once more, and these are dear to make.
#: A file of postings is that of some texts, whose digests are a dictionary of each row group then; spread by term, each posting held 64 bytes of its own, which don't compress.
UNMOVED = ("postings", "blocks", "proofs", "proof_roots")
#: Row groups of those tables, so that one key's rows are few of them; the digests that a row group's dictionary may hold; and the texts whose postings a task sorts.
GROUP_BYTES, DICTIONARY_BYTES, SPLIT_BYTES = 8 << 20, 4 << 20, 16 << 20
#: More parts of a table than this are written anew as one.
MERGE_PARTS = 16
#: For so many seconds a lock holds unless it is renewed; then its writer counts as lost.
LEASE_SECONDS = 3600


def _columns(name: str) -> list[str]:
    """A table's columns as its schema has them: name and type."""
    return re.split(r", (?![^<]*>)", (SCHEMAS | DERIVED)[name])


@dataclass(frozen=True)
class Delta:
    """How a library differs from the stored generation that it was opened at."""

    whole: dict[str, DataFrame]  # tables that are written as a whole
    removed: DataFrame | None = None  # ID of the conversations whose rows go
    added: dict[str, DataFrame] | None = None  # rows of documents, relations, entries, occurrences and contents
    dropped: DataFrame | None = None  # digest of the texts that go


@dataclass(frozen=True)
class Library:
    """The tables of one generation, with derived ones where they are stored and still true."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    library_id: str = "memory"
    generation: int = 0
    delta: Delta | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def stored(self, name: str) -> DataFrame | None:
        """A derived table, or None where it has to be worked out."""
        return self.tables.get(name)

    def with_tables(self, delta: Delta | None = None, **changed: DataFrame) -> Library:
        """The library with other tables, whose derived ones don't hold any more."""
        kept = {n: t for n, t in self.tables.items() if n not in DERIVED or not set(changed) & set(_SOURCES_OF[n])}
        return replace(self, tables=kept | changed, delta=delta)

    def near(self, native_ids: list[str]) -> Library:
        """The rows of these conversations, and of others that share a native_id; few are named one by one, so that scans skip what isn't theirs."""
        own = {"tracking", *BY_CONVERSATION, "roots", "proofs", "proof_roots"}
        return replace(self, tables={n: t.where(C.among("native_id", sorted(set(native_ids)))) if n in own else t for n, t in self.tables.items()})

    def spine(self) -> DataFrame:
        """One row for each tracked conversation with its effective state, activity and freshness; title and the like are null without a document."""
        t, s, d = self["tracking"], self["sources"], self["documents"].withColumn("has_document", F.lit(True))
        joined = t.join(s, ["source_kind", "instance_id"]).join(d, C.ID, "left")
        has = F.coalesce("has_document", F.lit(False))
        cov = F.col("coverage_status")
        latest = tuple(F.col(f"latest_{k}") for k in ("scheme", "digest", "adapter"))
        good = tuple(F.col(f"last_good_{k}") for k in ("scheme", "digest", "adapter"))
        return joined.select(
            *C.ID,
            "title",
            "workspace",
            "created_at",
            "updated_at",
            "lineage_coverage",
            "document_digest",
            "captured_at",
            "latest_outcome",
            "latest_failure",
            cov.alias("coverage_status"),
            has.alias("has_document"),
            F.col("last_good_adapter").alias("adapter_version"),
            C.source_state(cov, F.col("presence_status")).alias("source_state"),
            C.observed_at(cov, F.col("coverage_observed_at"), F.col("presence_observed_at")).alias("observed_at"),
            C.activity(F.col("updated_at"), F.col("created_at")).alias("activity"),
            C.freshness(has, latest, good, F.col("latest_outcome")).alias("freshness"),
        )

    def retained(self) -> DataFrame:
        return self.spine().where("has_document")


def empty(spark: SparkSession, library_id: str = "memory") -> Library:
    return Library(spark, {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}, library_id)


class Store:
    """A library's folder. Paths may be on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._owner: str | None = None

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))] if self._fs.exists(self._path(self.path)) else []

    def _read(self, name: str) -> dict | None:
        try:
            stream = self._fs.open(self._at(name))
        except Py4JJavaError:
            return None  # it went meanwhile
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        except ValueError:
            return None  # it is still being written
        finally:
            stream.close()

    def _write(self, name: str, content: dict, overwrite: bool) -> None:
        out = self._fs.create(self._at(name), overwrite)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    def _rename(self, name: str, to: str) -> None:
        """Fails where the target is there."""
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        self._context.rename(self._at(name), self._at(to), self.spark.sparkContext._gateway.new_array(kind, 0))

    def manifests(self) -> dict[int, str]:
        """The manifests' names by generation."""
        return {int(m[1]): n for n in self._names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n))}

    def manifest(self) -> dict | None:
        """The newest manifest, or None if nothing was ever committed."""
        known = self.manifests()
        if not known:
            return None
        found = self._read(known[max(known)])
        if found is None or found.get("schema_version") != SCHEMA_VERSION:
            raise OperationError("library-unavailable", "the library has another schema version")
        return found

    def _put(self, manifest: dict) -> None:
        """The one step that makes a generation the library."""
        if self._owner is not None and (self._read("writer.lock") or {}).get("owner") != self._owner:
            raise OperationError("library-busy", "another writer has taken over the library")
        temporary = f"manifest-{uuid.uuid4().hex}.tmp"
        self._write(temporary, manifest, False)
        try:
            self._rename(temporary, f"manifest-{manifest['generation']:012d}.json")
        except Py4JJavaError:
            self._fs.delete(self._at(temporary), False)
            raise OperationError("library-busy", "another writer has committed this generation") from None

    def lock(self, seconds: float = LEASE_SECONDS) -> None:
        """One writer at a time. A lock whose time is over is taken over: of several that try, one renames it away."""
        self._fs.mkdirs(self._path(self.path))
        owner = uuid.uuid4().hex
        for _ in range(2):
            try:
                self._write("writer.lock", {"owner": owner, "until": time.time() + seconds}, False)
                self._owner = owner
                return
            except Py4JJavaError:
                held = self._read("writer.lock")
                if held is None or held["until"] >= time.time():
                    break
                try:
                    self._rename("writer.lock", f"writer.lock.{owner}")
                except Py4JJavaError:
                    break
                self._fs.delete(self._at(f"writer.lock.{owner}"), False)
        raise OperationError("library-busy", "another writer holds the library")

    def renew(self, seconds: float = LEASE_SECONDS) -> None:
        if self._owner is not None and (self._read("writer.lock") or {}).get("owner") == self._owner:
            self._write("writer.lock", {"owner": self._owner, "until": time.time() + seconds}, True)

    def unlock(self) -> None:
        """Takes away this writer's lock, not another's."""
        if self._owner is not None and (self._read("writer.lock") or {}).get("owner") == self._owner:
            self._fs.delete(self._at("writer.lock"), False)
        self._owner = None

    def lock_state(self) -> str:
        """free, held or expired."""
        held = self._read("writer.lock") if "writer.lock" in self._names() else None
        return "free" if held is None else "held" if held["until"] >= time.time() else "expired"

    def pin(self, seconds: float) -> str:
        """Keeps the current generation's parts from compaction for so long; returns a name for unpin()."""
        found = self.manifest()
        name = f"pin-{found['generation'] if found else 0}-{int(time.time() + seconds)}-{uuid.uuid4().hex}"
        self._fs.create(self._at(name), False).close()
        return name

    def unpin(self, name: str) -> None:
        self._fs.delete(self._at(name), False)

    def _table(self, manifest: dict, name: str) -> DataFrame:
        """A table of all its parts, without the rows that later tombstones name."""
        schema = (SCHEMAS | DERIVED)[name]
        kind, keys = ("texts", ["digest"]) if name in BY_TEXT else ("conversations", C.ID)
        dead = manifest["dead"][kind] if name in BY_TEXT + BY_CONVERSATION else []
        by: dict[tuple[str, ...], list[str]] = {}
        for generation, part in manifest["parts"].get(name, []):
            by.setdefault(tuple(p for g, p in dead if g > generation), []).append(part)
        out = None
        for later, parts in by.items():
            df = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])
            if later:
                gone = self.spark.read.schema(", ".join(f"{k} string" for k in keys)).parquet(*[f"{self.path}/{p}" for p in later]).distinct()
                columns = df.columns
                df = df.join(gone, keys, "left_anti").select(columns)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _library(self, manifest: dict) -> Library:
        missing = set(manifest.get("missing", []))
        tables = {n: self._table(manifest, n) for n in SCHEMAS | DERIVED if n not in missing}
        return Library(self.spark, tables, manifest["library_id"], manifest["generation"])

    def open(self) -> Library | None:
        """The current generation, or None if nothing was ever written."""
        found = self.manifest()
        return None if found is None else self._library(found)

    def commit(self, library: Library, note: dict | None = None, derived: Iterable[str] | None = None) -> Library:
        """Makes the library the next generation: its delta to the current one where it has it, else all of its tables.

        A note is kept in this and later manifests, so what it tells holds exactly if the commit does.
        Where `derived` names derived tables, the others are left out until derive() or the next commit makes them; readers work them out.
        """
        return self._commit(library, note, frozenset(DERIVED if derived is None else derived))

    def derive(self, names: Iterable[str]) -> Library:
        """The current generation with these derived tables, too: those that it lacks are made and committed."""
        library = self.open()
        lacks = frozenset(n for n in names if library.stored(n) is None)
        return self._commit(library, None, lacks, False) if lacks else library

    def _commit(self, library: Library, note: dict | None, derived: frozenset[str], base: bool = True) -> Library:
        """commit(); without base, the current generation's tables stay and these derived ones come in addition."""
        with shared.shuffles_removed(self.spark):
            return self._written(library, note, derived, base)

    def _written(self, library: Library, note: dict | None, derived: frozenset[str], base: bool) -> Library:
        from threadlake.operators import lineage, listing, proof, search

        self.renew()
        found = self.manifest() or {"library_id": uuid.uuid4().hex, "generation": 0, "schema_version": SCHEMA_VERSION, "parts": {}, "dead": {"conversations": [], "texts": []}}
        generation = found["generation"] + 1
        folder = f"gen={generation}-{uuid.uuid4().hex[:8]}"
        # An empty library's delta is all of it.
        follows = library.delta is not None and library.generation == found["generation"] and (not library.generation or library.library_id == found["library_id"])
        # A change can't be added to tables that aren't there: the generation is written as a whole then.
        follows = follows and base and derived == frozenset(DERIVED) and not found.get("missing")
        kept = follows or not base
        parts = {n: list(p) for n, p in found["parts"].items()} if kept else {}
        dead = {k: list(p) for k, p in found["dead"].items()} if kept else {"conversations": [], "texts": []}
        left = [n for n in (DERIVED if base else found.get("missing", [])) if n not in derived]
        after = found | {"missing": left} | {"generation": generation, "parts": parts, "dead": dead} | (note or {})

        def write(name: str, df: DataFrame) -> None:
            if name in UNMOVED:
                df = df if name == "blocks" else df.sortWithinPartitions(*BY_KEY[name])
            elif name in BY_KEY:
                df = df.repartitionByRange(*BY_KEY[name]).sortWithinPartitions(*BY_KEY[name])
            elif by := [c for c in [*C.ID, "ordinal", "segment_ordinal", "digest", "run_id"] if c in df.columns]:
                df = df.sortWithinPartitions(*by)
            out = df.select([c.split(" ")[0] for c in _columns(name)]).write
            out = out.option("parquet.dictionary.page.size", DICTIONARY_BYTES) if name == "postings" else out
            (out.option("parquet.block.size", GROUP_BYTES) if name in BY_KEY else out).parquet(f"{self.path}/{folder}/{name}")

        def stored(tables: dict[str, DataFrame], alone: bool) -> None:
            """Writes tables that don't depend on each other, side by side: each is a job of its own."""
            with ThreadPoolExecutor(8) as pool:
                list(pool.map(lambda n: write(n, tables[n]), tables))
            for name in tables:
                parts[name] = ([] if alone else parts.get(name, [])) + [[generation, f"{folder}/{name}"]]

        def fresh(name: str) -> DataFrame:
            return self.spark.read.schema((SCHEMAS | DERIVED)[name]).parquet(f"{self.path}/{folder}/{name}")

        def index_texts(texts: DataFrame) -> None:
            """The index of texts that are new; its blocks and totals follow from the postings as written."""
            bits = search.range_bits(texts.count())
            with shared.set_for(self.spark, "spark.sql.files.maxPartitionBytes", SPLIT_BYTES):
                stored({n: make(texts) for n, make in (("lengths", search.lengths), ("postings", lambda t: search.postings(t, bits))) if n in derived}, not follows)
            made = fresh("postings") if "postings" in derived else search.postings(texts, bits)
            stored({n: df for n, df in (("corpus", search.totals(texts, made)), ("blocks", search.partial_blocks(made))) if n in derived}, not follows)

        def further(tables: dict[str, DataFrame], label: str) -> None:
            """Rows of tables that were perhaps written already in this commit."""
            for name, df in tables.items():
                df.select([c.split(" ")[0] for c in _columns(name)]).write.parquet(f"{self.path}/{folder}/{label}/{name}")
                parts.setdefault(name, []).append([generation, f"{folder}/{label}/{name}"])

        def bury(kind: str, df: DataFrame) -> None:
            df.write.parquet(f"{self.path}/{folder}/dead-{kind}")
            dead[kind].append([generation, f"{folder}/dead-{kind}"])

        if follows:
            delta = library.delta
            stored(delta.whole, True)
            if delta.removed is not None:
                bury("conversations", delta.removed.select(*C.ID).distinct())
            if delta.dropped is not None:
                bury("texts", delta.dropped.select("digest").distinct())
            if delta.added:
                stored(delta.added, False)
                # A document's texts may be in the library already, so sizes are looked up in all contents.
                made = replace(library, tables={n: fresh(n) if n in delta.added else library[n] for n in SCHEMAS} | {"contents": self._table(after, "contents")})
                index_texts(fresh("contents"))
                stored({"places": search.text_places(fresh("occurrences")), "metrics": listing.computed_metrics(made), "proofs": proof.blocks(made)}, False)
                stored({"proof_roots": proof.roots(made, fresh("proofs"))}, False)
            if delta.dropped is not None:
                # What goes is taken off the totals, which have no row for each text.
                gone = self._table(found, "contents").join(delta.dropped.select("digest").distinct(), "digest", "left_semi")
                less = search.corpus(search.lengths(gone)).select(*[(-F.col(c)).alias(c) for c in ("texts", "tokens")])
                further({"blocks": search.without_blocks(search.postings(gone)), "corpus": less}, "dropped")
            if delta.removed is not None or delta.added:
                stored({"roots": lineage.resolved(self._library(after))}, True)
        else:
            if base:
                stored({n: library[n] for n in SCHEMAS}, True)
            made = Library(self.spark, {n: self._table(after, n) for n in SCHEMAS})
            if derived & {"lengths", "postings", "corpus", "blocks"}:
                index_texts(made["contents"])
            makers = {"places": lambda: search.text_places(made["occurrences"]), "metrics": lambda: listing.computed_metrics(made), "roots": lambda: lineage.resolved(made), "proofs": lambda: proof.blocks(made)}
            stored({n: make() for n, make in makers.items() if n in derived}, True)
            if "proof_roots" in derived:
                stored({"proof_roots": proof.roots(made, self._table(after, "proofs"))}, True)
        self._put(after)
        if max(len(p) for p in parts.values()) > MERGE_PARTS:
            return self.commit(replace(self.open(), delta=None))
        return self.open()

    def compact(self, files: int = 8) -> int:
        """Rewrites the current generation as one part of few files a table and deletes older generations; returns how many went.

        What a pinned generation reads stays until its pin's time is over.
        """
        library = self.open()
        if library is None:
            return 0
        self.commit(replace(library, tables={n: t.coalesce(files) for n, t in library.tables.items() if n in SCHEMAS}, delta=None))
        names = self._names()
        pins = [re.fullmatch(r"pin-(\d+)-(\d+)-\w+", n) for n in names]
        pinned = {int(m[1]) for m in pins if m and int(m[2]) >= time.time()}
        known = self.manifests()
        kept = {g: self._read(n) for g, n in known.items() if g == max(known) or g in pinned}
        used = {p.split("/")[0] for m in kept.values() for parts in [*m["parts"].values(), *m["dead"].values()] for _, p in parts}
        for generation, name in known.items():
            if generation not in kept:
                self._fs.delete(self._at(name), False)
        for name in names:
            expired = re.fullmatch(r"pin-\d+-(\d+)-\w+", name)
            if (name.startswith("gen=") and name not in used) or (expired and int(expired[1]) < time.time()):
                self._fs.delete(self._at(name), True)
        return len(known) - len(kept)

    def staging(self) -> str:
        """A new path for what a writer reads once and uses several times."""
        return f"{self.path}/staging-{uuid.uuid4().hex}"

    def discard(self, staged: str) -> None:
        self._fs.delete(self._path(staged), True)

    def clear(self, confirmed: bool = False) -> None:
        """Deletes the library, under its lock."""
        if not confirmed:
            raise ValueError("clearing a library needs confirmed=True")
        self.lock()
        try:
            for name in self._names():
                if name != "writer.lock":
                    self._fs.delete(self._at(name), True)
        finally:
            self.unlock()
        self._fs.delete(self._path(self.path), True)
