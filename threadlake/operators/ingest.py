"""Incremental indexing: what a run discovers is compared with what is tracked, and the tables follow.

A run over one source takes the discovered candidates (identity and revision),
the documents read of the changed ones and the failures. Every step is a join on
the identity, so a run over millions of conversations is a few shuffles; nothing
is updated in place. The result is the next generation's tables and, as a delta, what
of them is new: an unchanged conversation's rows are neither read nor written.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import columns as C
from threadlake.operators import transcript
from threadlake.operators.library import SCHEMAS, Delta, Library
from threadlake.plans.requests import OperationError

REVISION = ["scheme", "digest", "adapter"]
KEPT_RUNS, KEPT_ITEMS = 20, 100
_BODY = ("documents", "relations", "entries", "occurrences")


@dataclass(frozen=True)
class Snapshot:
    """What an adapter read of the changed conversations: tables of the library's schemas (contents too)."""

    tables: dict[str, DataFrame]


def discovered(candidates: DataFrame) -> DataFrame:
    """Candidates once each; an identity with two revisions makes the whole discovery fail, so that no absence is inferred from it."""
    once = candidates.select(*C.ID, *REVISION).distinct()
    clash = once.groupBy(*C.ID).count().where("count > 1")
    if clash.take(1):
        raise OperationError("discovery-failed", "a conversation was discovered with two revisions")
    return once


def changes(tracking: DataFrame, candidates: DataFrame) -> DataFrame:
    """ID, status (unchanged, changed or new) and the candidate's revision: equal to the last good one or not."""
    last = tracking.select(*C.ID, *[F.col(f"last_good_{k}").alias(f"old_{k}") for k in REVISION], F.lit(True).alias("tracked"))
    same = F.lit(True)
    for k in REVISION:
        same = same & F.col(k).eqNullSafe(F.col(f"old_{k}"))
    status = F.when(F.col("tracked").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return candidates.join(last, C.ID, "left").select(*C.ID, *REVISION, status.alias("status"))


def missing(tracking: DataFrame, candidates: DataFrame, kind: str, instance: str) -> DataFrame:
    """Tracked conversations of the source that weren't discovered."""
    own = tracking.where((F.col("source_kind") == kind) & (F.col("instance_id") == instance))
    return own.select(*C.ID).join(candidates.select(*C.ID), C.ID, "left_anti")


def intern(contents: DataFrame, fresh: DataFrame) -> DataFrame:
    """contents and those of fresh that it doesn't have; equal texts are one row, equal digests of different texts stay two."""
    new = fresh.dropDuplicates(["digest", "text"]).join(contents, ["digest", "text"], "left_anti")
    return contents.unionByName(new.select("digest", "text"))


def referenced(library: Library) -> DataFrame:
    """The contents that some occurrence refers to."""
    used = library["occurrences"].where("digest IS NOT NULL").select("digest").distinct()
    return library["contents"].join(used, "digest", "left_semi").select("digest", "text")


def unreferenced(digests: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Those of the digests that no occurrence refers to."""
    return digests.where("digest IS NOT NULL").select("digest").distinct().join(occurrences.where("digest IS NOT NULL").select("digest"), "digest", "left_anti")


def begun(library: Library, kind: str, instance: str, at: str) -> Library:
    """The library with an active run of the source, whose coverage is unknown until it ends.

    The writer's lock is held, so any other run that still counts as active was interrupted: it ends here.
    """
    spark = library.spark
    run_id = _next_run(library)
    stopped = library["runs"].withColumns({"finished_at": F.when(F.col("status") == "active", F.lit(at)).otherwise(F.col("finished_at")), "status": F.when(F.col("status") == "active", "interrupted").otherwise(F.col("status"))})
    row = (run_id, kind, instance, "active", at, None, None, *[0] * 7)
    runs = stopped.select(library["runs"].columns).unionByName(spark.createDataFrame([row], SCHEMAS["runs"]))
    changed = {"runs": runs, "sources": _covered(library, kind, instance, "unknown", at)}
    return library.with_tables(Delta(changed), **changed)


def _covered(library: Library, kind: str, instance: str, status: str, at: str) -> DataFrame:
    source = library.spark.createDataFrame([(kind, instance)], "source_kind string, instance_id string")
    others = library["sources"].join(F.broadcast(source), ["source_kind", "instance_id"], "left_anti")
    return others.unionByName(source.select("*", F.lit(status).alias("coverage_status"), F.lit(at).alias("coverage_observed_at")))


def run(library: Library, kind: str, instance: str, candidates: DataFrame | None, snapshot: Snapshot, failures: DataFrame, started_at: str, finished_at: str, failure: str | None = None) -> Library:
    """The library after a run over one source.

    failures has ID and failure_code, of changed candidates that couldn't be read:
    their last good document stays. candidates None means that discovery failed
    (failure says how): coverage becomes unknown and nothing else changes. Documents
    in the snapshot that aren't changed candidates are ignored.
    """
    t = library["tracking"]
    coverage = "complete" if failure is None and candidates is not None else "unknown"
    sources = _covered(library, kind, instance, coverage, started_at)
    if candidates is None:
        done = library.with_tables(Delta({"sources": sources}), sources=sources)
        return _finished(done, kind, instance, {}, started_at, finished_at, "failed", failure or "discovery-failed", None)
    seen = changes(t, discovered(candidates))
    failed = seen.where("status <> 'unchanged'").join(failures.select(*C.ID, "failure_code"), C.ID)
    read = seen.where("status <> 'unchanged'").join(snapshot.tables["documents"].select(*C.ID), C.ID, "left_semi").join(failed.select(*C.ID), C.ID, "left_anti")
    gone = missing(t, candidates, kind, instance)

    new = seen.select(*C.ID, *[F.col(k).alias(f"new_{k}") for k in REVISION]).join(read.select(*C.ID, F.lit(True).alias("was_read")), C.ID, "left")
    new = new.join(failed.select(*C.ID, "failure_code"), C.ID, "left").withColumn("was_seen", F.lit(True))
    absent = gone.withColumn("was_gone", F.lit(True))
    merged = t.join(new, C.ID, "full").join(absent, C.ID, "left")
    was_read, was_failed, was_seen, was_gone = (F.coalesce(c, F.lit(False)) for c in (F.col("was_read"), F.col("failure_code").isNotNull(), F.col("was_seen"), F.col("was_gone")))
    tracking = merged.select(
        *C.ID,
        *[F.when(was_read, F.col(f"new_{k}")).otherwise(F.col(f"last_good_{k}")).alias(f"last_good_{k}") for k in REVISION],
        *[F.when(was_seen, F.col(f"new_{k}")).otherwise(F.col(f"latest_{k}")).alias(f"latest_{k}") for k in REVISION],
        F.when(was_failed, "failed").when(was_seen, "succeeded").otherwise(F.col("latest_outcome")).alias("latest_outcome"),
        F.when(was_seen, F.col("failure_code")).otherwise(F.col("latest_failure")).alias("latest_failure"),
        F.when(was_seen, "present").when(was_gone, "missing").otherwise(F.col("presence_status")).alias("presence_status"),
        F.when(was_seen | was_gone, F.lit(started_at)).otherwise(F.col("presence_observed_at")).alias("presence_observed_at"),
        F.when(was_read, F.lit(started_at)).otherwise(F.col("captured_at")).alias("captured_at"),
        F.when(was_seen, F.lit(started_at)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    whole = {"sources": sources, "tracking": tracking}
    stale = failed.join(library["documents"].select(*C.ID), C.ID, "left_semi")
    tagged = seen.select(F.lit("discovered").alias("of")).unionByName(seen.where("status = 'unchanged'").select(F.lit("unchanged").alias("of")))
    for of, rows in (("indexed", read), ("failed", failed), ("missing", gone), ("stale", stale)):
        tagged = tagged.unionByName(rows.select(F.lit(of).alias("of")))
    n = dict.fromkeys(("discovered", "unchanged", "indexed", "failed", "missing", "stale"), 0) | {r["of"]: r["count"] for r in tagged.groupBy("of").count().collect()}
    if n["discovered"] != n["unchanged"] + n["indexed"] + n["failed"]:
        raise OperationError("repository-write", "a changed candidate was neither read nor failed")
    items = failed.select(*C.ID, F.lit("failed").alias("outcome"), "failure_code").unionByName(gone.select(*C.ID, F.lit("missing").alias("outcome"), F.lit(None).cast("string").alias("failure_code")))
    after = library.with_tables(Delta(whole), **whole)
    if n["indexed"]:
        fresh = {name: snapshot.tables[name].join(read.select(*C.ID), C.ID, "left_semi").select(library[name].columns) for name in _BODY}
        used = fresh["occurrences"].where("digest IS NOT NULL").select("digest").distinct()
        texts = snapshot.tables["contents"].join(used, "digest", "left_semi").select("digest", "text")
        made = library.with_tables(**fresh, contents=texts)
        digests = transcript.document_digests(made).select(*C.ID, "document_digest")
        fresh["documents"] = fresh["documents"].drop("document_digest").join(digests, C.ID, "left").select(library["documents"].columns)
        bodies = {name: library[name].join(read.select(*C.ID), C.ID, "left_anti").unionByName(fresh[name]) for name in _BODY}
        # Only texts that a changed conversation had before can have lost their last occurrence.
        former = library["occurrences"].join(read.select(*C.ID), C.ID, "left_semi")
        dropped = unreferenced(former, bodies["occurrences"])
        new = texts.dropDuplicates(["digest", "text"]).join(library["contents"], ["digest", "text"], "left_anti").select("digest", "text")
        contents = library["contents"].join(dropped, "digest", "left_anti").select("digest", "text").unionByName(new)
        after = library.with_tables(Delta(whole, read.select(*C.ID), fresh | {"contents": new}, dropped), **whole, **bodies, contents=contents)
    return _finished(after, kind, instance, n, started_at, finished_at, "completed", None, items)


def _next_run(library: Library) -> int:
    return (library["runs"].agg(F.max("run_id")).collect()[0][0] or 0) + 1


def _finished(library: Library, kind: str, instance: str, n: dict, started: str, finished: str, status: str, failure: str | None, items: DataFrame | None) -> Library:
    """The run's row, in place of the source's active one where it has one, and its first items."""
    spark = library.spark
    own = (F.col("source_kind") == kind) & (F.col("instance_id") == instance) & (F.col("status") == "active")
    active = library["runs"].where(own).agg(F.max("run_id")).collect()[0][0]
    run_id = active or _next_run(library)
    first, omitted = None, 0
    if items is not None:
        # The first KEPT_ITEMS by identity are kept and the rest is counted: a report, not data.
        first = items.orderBy(*C.ID).limit(KEPT_ITEMS).withColumn("item", (F.row_number().over(Window.orderBy(*C.ID)) - 1).cast("long"))
        omitted = max(0, n["failed"] + n["missing"] - KEPT_ITEMS)
    row = (run_id, kind, instance, status, started, finished, failure, *[n.get(k, 0) for k in ("discovered", "unchanged", "indexed", "failed", "missing", "stale")], omitted)
    runs = retained_runs(library["runs"].where(F.col("run_id") != run_id).unionByName(spark.createDataFrame([row], SCHEMAS["runs"])))
    run_items = library["run_items"]
    if first is not None:
        columns = run_items.columns
        run_items = run_items.unionByName(first.withColumn("run_id", F.lit(run_id).cast("long")).select(columns))
    changed = {"runs": runs, "run_items": run_items.join(runs.select("run_id"), "run_id", "left_semi").select(run_items.columns)}
    delta = library.delta or Delta({"sources": library["sources"]})
    return library.with_tables(replace(delta, whole=delta.whole | changed), **changed)


def retained_runs(runs: DataFrame, most: int = KEPT_RUNS) -> DataFrame:
    """The newest finished runs of each source, and all that aren't finished."""
    rank = F.row_number().over(Window.partitionBy("source_kind", "instance_id", F.col("finished_at").isNull()).orderBy(F.desc("finished_at"), F.desc("run_id")))
    return runs.withColumn("rank", rank).where(F.col("finished_at").isNull() | (F.col("rank") <= most)).select(runs.columns)


def report(library: Library) -> DataFrame:
    """The latest ended run of each source, with whether it was complete and its items, each with the conversation's latest state."""
    rank = F.row_number().over(Window.partitionBy("source_kind", "instance_id").orderBy(F.desc("run_id")))
    last = library["runs"].where("status <> 'active'").withColumn("rank", rank).where("rank = 1").drop("rank").withColumn("complete", F.col("status") == "completed")
    tracked = library["tracking"].select(*C.ID, "latest_outcome", "presence_status")
    item = F.struct("item", *C.ID, "outcome", "failure_code", "latest_outcome", "presence_status")
    placed = library["run_items"].join(last.select("run_id"), "run_id", "left_semi").join(tracked, C.ID, "left")
    items = placed.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # KEPT_ITEMS at most
    return last.join(items, "run_id", "left")


def totals(report: DataFrame) -> DataFrame:
    """One row over the sources of a report: how many there are, how many are complete, and the sums of their counts."""
    counts = ("discovered", "unchanged", "indexed", "failed", "missing", "stale", "omitted_items")
    return report.agg(F.count("*").alias("sources"), F.count_if("complete").alias("complete_sources"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def collapse_adjacent(records: DataFrame) -> DataFrame:
    """Of neighbouring messages that tell the same (actor, timestamp, segments) in the other record family, one stays.

    records: ID, ordinal, family (event, response, or null for a record that isn't a
    message and parts its neighbours), actor, timestamp, segments (any comparable
    value). Each message that equals the one held and is of the other family is taken
    into it, and what is held then counts as a response, which wins. The held ordinal
    stays. As that changes what the next message meets, it is a fold; a window first
    cuts a conversation into runs of equal neighbours, and only a run is folded.
    """
    w = Window.partitionBy(*C.ID).orderBy("ordinal")
    same = F.col("family").isNotNull() & F.lag("family").over(w).isNotNull()
    for c in ("actor", "timestamp", "segments"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = records.withColumn("begins", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("begins").over(w))
    grouped = runs.groupBy(*C.ID, "run", "actor", "timestamp", "segments").agg(F.array_sort(F.collect_list(F.struct("ordinal", "family"))).alias("m"))

    def step(held, x):
        last = F.try_element_at(held, F.lit(-1))
        merged = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct(last["ordinal"].alias("ordinal"), F.lit("response").alias("family"))))
        return F.when((F.size(held) > 0) & (last["family"] != x["family"]), merged).otherwise(F.array_append(held, x))

    none = F.array().cast("array<struct<ordinal:bigint,family:string>>")
    folded = grouped.select(*C.ID, "actor", "timestamp", "segments", F.explode(F.aggregate("m", none, step)).alias("e"))
    return folded.select(*C.ID, "e.ordinal", "e.family", "actor", "timestamp", "segments")


def link_tools(entries: DataFrame) -> DataFrame:
    """related_ordinal of every tool result: its call's ordinal, before or after it. A call id with two calls or two results is malformed."""
    calls = entries.where("entry_kind = 'tool-call' AND tool_call_id IS NOT NULL").select(*C.ID, "tool_call_id", F.col("ordinal").alias("call_ordinal"))
    results = entries.where("entry_kind = 'tool-result' AND tool_call_id IS NOT NULL").select(*C.ID, "tool_call_id", F.col("ordinal").alias("result_ordinal"))
    twice = calls.groupBy(*C.ID, "tool_call_id").agg(F.count("*").alias("n")).unionByName(results.groupBy(*C.ID, "tool_call_id").agg(F.count("*").alias("n")))
    bad = twice.where("n > 1").select(*C.ID).distinct()
    linked = results.join(calls, [*C.ID, "tool_call_id"]).join(bad.withColumn("malformed", F.lit(True)), C.ID, "left")
    return linked.select(*C.ID, "tool_call_id", "call_ordinal", "result_ordinal", F.coalesce("malformed", F.lit(False)).alias("malformed"))


def link_turns(turns: DataFrame) -> DataFrame:
    """ID, ordinal of a turn's end and of its start, where exactly one start has the turn's id (ID, ordinal, entry_kind, turn_id)."""
    starts = turns.where("entry_kind = 'turn-started'").groupBy(*C.ID, "turn_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("start_ordinal")).where("n = 1").drop("n")
    return turns.where("entry_kind IN ('turn-completed', 'turn-aborted')").join(starts, [*C.ID, "turn_id"]).select(*C.ID, "turn_id", "ordinal", "start_ordinal")
