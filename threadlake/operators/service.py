"""The engine's API: requests in, pages out. Results are small by contract (a page), so they are plain Python values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import doctor, entries, ingest, lineage, listing, maintenance, scope, search, transcript
from threadlake.operators.library import Delta, Library, Store, empty
from threadlake.plans import cursors
from threadlake.plans.requests import (
    EntriesRequest,
    ListRequest,
    ManifestRequest,
    OperationError,
    SearchRequest,
    TranscriptRequest,
    UsageError,
    disclosed,
    fingerprint,
)
from threadlake.sources import normal


def _plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


@dataclass
class Engine:
    """Queries over one library. An engine without a library answers with empty pages."""

    library: Library
    initialised: bool = True

    @classmethod
    def open(cls, spark: SparkSession, path: str, pin_seconds: float = 0) -> Engine:
        """pin_seconds: for so long compaction leaves the generation that is opened."""
        store = Store(spark, path)
        if pin_seconds and store.manifest():
            store.pin(pin_seconds)
        found = store.open()
        return cls(found) if found else cls(empty(spark), False)

    def _start(self, request) -> cursors.Position:
        if request.cursor is None:
            return cursors.Position()
        return cursors.decode(request.cursor, fingerprint(request), self.library.library_id, self.library.generation)

    def _cursor(self, request, position: cursors.Position) -> str:
        return cursors.encode(fingerprint(request), self.library.library_id, self.library.generation, position)

    def _scope(self, f) -> dict:
        applied, unassessed = disclosed(f)
        return _plain(scope.capture_scope(self.library, f).collect()[0]) | {"applied_filters": applied, "unassessed_filters": unassessed}

    def _anchored(self, position: cursors.Position, length: int, still_there) -> tuple | None:
        if position.after is None:
            return None
        if len(position.after) != length or not still_there(position.after):
            raise UsageError("invalid-cursor", "the cursor's row isn't among the results")
        return position.after

    def _page(self, page: DataFrame) -> tuple[Library, DataFrame]:
        """A page's rows, worked out once, and the library's rows of their conversations, from which the page is completed.

        Roots that aren't stored are resolved over the whole library.
        """
        rows = page.collect()
        near = self.library.near([r["native_id"] for r in rows])
        if self.library.stored("roots") is None:
            near = replace(near, tables=near.tables | {"roots": lineage.roots(self.library)})
        return near, self.library.spark.createDataFrame(rows, page.schema)

    def list(self, request: ListRequest = ListRequest()) -> dict:
        position = self._start(request)
        rows = listing.conversations(self.library, request.filter)
        same = lambda a: rows.where(F.struct(*C.ID) == F.struct(*[F.lit(v).alias(c) for c, v in zip(C.ID, a[1:])])).take(1)
        anchor = self._anchored(position, 4, same)
        page = listing.page(self.library, request.filter, request.limit, anchor) if anchor or not position.offset else rows.orderBy(*listing.order()).offset(position.offset).limit(request.limit + 1)
        near, rows = self._page(page)
        found = lineage.with_root(rows, near).orderBy(*listing.order()).collect()
        out = {"conversations": [_plain(r) for r in found[: request.limit]], "capture_scope": self._scope(request.filter), "next_cursor": None}
        if len(found) > request.limit:
            last = found[request.limit - 1]
            out["next_cursor"] = self._cursor(request, cursors.Position(tuple(last[c] for c in ["activity", *C.ID])))
        return out

    def entries(self, request: EntriesRequest = EntriesRequest()) -> dict:
        position = self._start(request)
        rows = entries.selected(self.library, request.filter, request.selection)
        same = lambda a: rows.where(F.struct(*entries.KEY) == F.struct(*[F.lit(v).alias(c) for c, v in zip(entries.KEY, a)])).take(1)
        anchor = self._anchored(position, 4, same)
        page = entries.page(self.library, request.filter, request.selection, request.limit, anchor) if anchor or not position.offset else rows.orderBy(*entries.KEY).offset(position.offset).limit(request.limit + 1)
        near, rows = self._page(page)
        shown = entries.previews(entries.segment_counts(rows, near), near, request.filter.origin)
        found = lineage.with_root(shown, near).orderBy(*entries.KEY).collect()
        out = {"entries": [_plain(r) for r in found[: request.limit]], "capture_scope": self._scope(request.filter), "next_cursor": None}
        if len(found) > request.limit:
            out["next_cursor"] = self._cursor(request, cursors.Position(tuple(found[request.limit - 1][c] for c in entries.KEY)))
        return out

    def search(self, request: SearchRequest) -> dict:
        offset = self._start(request).offset
        index = search.index(self.library)
        matches = search.matching(self.library, request.text, request.filter, request.mode, index)
        page = search.page(self.library, request.text, request.filter, request.mode, request.limit, offset, index)
        near, rows = self._page(page)
        shown = lineage.with_root(search.with_snippets(rows, near, request.text), near)
        found = shown.orderBy(*search.order()).collect()
        out = {
            "hits": [_plain(r) for r in found[: request.limit]],
            "support": _plain(search.support(matches, self.library).collect()[0]),
            "capture_scope": self._scope(request.filter),
            "next_cursor": None,
        }
        if request.context and out["hits"]:
            self._add_context(out["hits"], request.context)
        if len(found) > request.limit:
            out["next_cursor"] = self._cursor(request, cursors.Position(None, offset + request.limit))
        return out

    def _add_context(self, hits: list[dict], context: int) -> None:
        """Adjacent entries and tool partners of a page's hits, with bodies of 512 bytes at most."""
        library = self.library.near([h["native_id"] for h in hits])
        primary = library.spark.createDataFrame([tuple(h[k] for k in entries.KEY) for h in hits], "source_kind string, instance_id string, native_id string, ordinal long")
        near = entries.adjacent(primary, library, context).select(*entries.KEY, "context_ordinal", F.lit(True).alias("adjacent"), F.lit(False).alias("linked_truncated"))
        far = entries.linked(primary, library, context).select(*entries.KEY, F.col("partner").alias("context_ordinal"), F.lit(False).alias("adjacent"), "linked_truncated")
        both = near.unionByName(far)
        own = entries.partners(library).withColumnRenamed("partner", "context_ordinal").withColumn("linked", F.lit(True))
        keyed = both.join(own, [*entries.KEY, "context_ordinal"], "left")
        there = keyed.select(*C.ID, F.col("context_ordinal").alias("ordinal")).distinct()
        bodies = entries.bodies(there.join(library["entries"], entries.KEY), library)
        cut = bodies.select(*C.ID, F.col("ordinal").alias("context_ordinal"), "entry_kind", "actor", "timestamp", C.truncated_utf8(F.col("body"), 512).alias("body"))
        rows = keyed.join(cut, [*C.ID, "context_ordinal"]).collect()
        by: dict[tuple, list] = {}
        for r in rows:
            by.setdefault(tuple(r[k] for k in entries.KEY), []).append(r)
        for h in hits:
            found = sorted(by.get(tuple(h[k] for k in entries.KEY), []), key=lambda r: r["context_ordinal"])
            h["context"] = [_plain(r) for r in found]
            h["linked_context_truncated"] = any(r["linked_truncated"] for r in found)

    def manifest(self, request: ManifestRequest = ManifestRequest()) -> dict:
        rows = listing.manifest_rows(self.library, request.filter)
        return {"revisions": [_plain(r) for r in rows], "capture_scope": self._scope(request.filter)}

    def show(self, request: TranscriptRequest) -> dict:
        if not self.initialised:
            raise OperationError("conversation-not-found", "the library has no conversations")
        return transcript.show(self.library, request)

    export = show

    def doctor(self, full: bool = False) -> dict[str, int]:
        return {r["check"]: r["broken"] for r in doctor.diagnose(self.library, full).collect()}


class Writer:
    """Changes to a stored library: each takes the lock, makes the next generation and swaps it in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def _change(self, *steps) -> Library:
        """Each step makes a library of the current one, which is then committed."""
        self.store.lock()
        try:
            for how in steps:
                done = self.store.commit(how(self.store.open() or empty(self.spark)))
            return done
        finally:
            self.store.unlock()

    def index(self, kind: str, instance: str, candidates, snapshot, failures, started_at: str, finished_at: str, failure: str | None = None) -> Library:
        """A run: first it is entered as active, so that one that breaks off is seen as interrupted, then its outcome is."""
        begin = lambda lib: ingest.begun(lib, kind, instance, started_at)
        return self._change(begin, lambda lib: ingest.run(lib, kind, instance, candidates, snapshot, failures, started_at, finished_at, failure))

    def index_read(self, kind: str, instance: str, candidates, read, heads, locator: str, started_at: str, finished_at: str, failures=None, failure: str | None = None) -> Library:
        """index() of normal.read_documents(): the read is written once, so files that change meanwhile can't make tables that disagree.

        failures (ID, failure_code) are those of conversations that weren't even read.
        """
        staged = self.store.staging()
        try:
            read.write.parquet(staged)
            snapshot, failed = normal.snapshot(self.spark.read.schema(read.schema).parquet(staged), heads, locator)
            return self.index(kind, instance, candidates, snapshot, failed if failures is None else failed.unionByName(failures.select(failed.columns)), started_at, finished_at, failure)
        finally:
            self.store.discard(staged)

    def forget(self, identity: tuple[str, str, str]) -> Library:
        return self._change(lambda lib: maintenance.forget(lib, identity))

    def repair_orphans(self) -> Library:
        return self._change(maintenance.repair_orphans)

    def repair_in_windows(self, rows: int = maintenance.WINDOW_ROWS, size: int = maintenance.WINDOW_BYTES) -> Iterator[dict[str, Any]]:
        """repair_orphans() by windows of bounded rows and bytes, each its own commit; yields what the repair has done after each.

        How far it has come is in the manifest of the same commit. One that breaks off is gone on with
        behind its last window, and its sums go on, whatever other writers have committed meanwhile.
        """
        self.store.lock()
        staged = self.store.staging()
        try:
            library = self.store.open()
            if library is None:
                return
            done = self.store.manifest().get("repair") or {}
            if done.get("ended", True):
                done = {"windows": 0, "rows": 0, "bytes": 0, "after": "", "ended": False}
            maintenance.windows(library, done["after"], rows, size).write.parquet(staged)
            cut = self.spark.read.schema("last string, rows long, bytes long").parquet(staged)
            left = cut.count()
            if not left and done["windows"]:
                self.store.commit(library.with_tables(Delta({})), {"repair": done | {"ended": True}})
            for w in cut.orderBy("last").toLocalIterator():
                left -= 1
                step = maintenance.repair_between(library, done["after"], w.last)
                done = {"windows": done["windows"] + 1, "rows": done["rows"] + w.rows, "bytes": done["bytes"] + w.bytes, "after": w.last, "ended": not left}
                library = self.store.commit(step, {"repair": done})
                yield done
        finally:
            self.store.discard(staged)
            self.store.unlock()

    def compact(self) -> int:
        self.store.lock()
        try:
            return self.store.compact()
        finally:
            self.store.unlock()

    def clear(self, confirmed: bool = False) -> None:
        self.store.clear(confirmed)

    def paths(self, sources: dict[str, str] | None = None) -> dict[str, Any]:
        """Where the library is and in which state, and of each source folder whether it can be read."""
        found = self.store.manifest()
        from threadlake.sources import discovery

        probes = {kind: discovery.probe(self.spark, path) for kind, path in (sources or {}).items()}
        return {"library": self.store.path, "initialised": found is not None, "generation": found["generation"] if found else 0, "lock": self.store.lock_state(), "sources": probes}
