"""Adapters from flat tables (conversations, documents, events) to the canonical library.

Those tables hold no capture history, so states, failures, times, lineage and
segments follow from the rows' ids by fixed rules; they exercise every state an
index run can leave behind. Every row's whole text is there. What stands beside:

* for each 14th document, another tracked conversation (lost-...) whose first capture failed;
* a conversation's texts are two segments, parted at the first blank, and each third
  entry has one more that was omitted;
* of every tenth user, all results belong to the first call;
* users descend from user n div 2; some are roots of their own, some have a second
  ancestor, some are in a cycle of two, some edges are weak or lead nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import columns as C
from threadlake.operators.library import DERIVED, SCHEMAS, Library, Store, empty
from threadlake.sources import shared


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(n) -> F.Column:
    return F.concat(F.lit("2024-04-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))


def _conversations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    key = [F.lit("conversation").alias("source_kind"), F.lit("testdata").alias("instance_id"), F.col("conv_id").cast("string").alias("native_id")]
    order = Window.partitionBy("conv_id").orderBy("turn")
    role = F.col("role")
    actor = F.when(role == "user", "human").when(role == "assistant", "model").when(role == "system", "system").otherwise("unknown")
    rows = raw.select(*key, "conv_id", "turn", "text", actor.alias("actor"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"))
    one = raw.select(*key, "conv_id").distinct()
    return {
        "heads": one.select(*C.ID, F.col("conv_id").alias("n"), *[F.lit(None).cast("string").alias(c) for c in ("title", "workspace", "created_at", "updated_at")]),
        "entries": rows.select(*C.ID, "ordinal", F.lit("message").alias("entry_kind"), "actor", F.lit(None).cast("string").alias("timestamp"), "text", F.col("actor").alias("origin")),
    }


def _documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    key = [F.lit("document").alias("source_kind"), F.col("source").alias("instance_id"), F.col("doc_id").cast("string").alias("native_id")]
    n = F.col("doc_id")
    heads = raw.select(
        *key,
        n.alias("n"),
        F.concat(F.lit("Document "), n.cast("string")).alias("title"),
        F.col("lang").alias("workspace"),
        F.when(n % 15 != 0, _day(n)).alias("created_at"),
        F.when(n % 5 != 0, _day(n * 3 + 1)).alias("updated_at"),
        F.lit(False).alias("lost"),
    )
    lost = heads.where("n % 14 = 0").withColumns({"native_id": F.concat(F.lit("lost-"), F.col("native_id")), "lost": F.lit(True)})
    return {
        "heads": heads.unionByName(lost),
        "entries": raw.select(*key, F.lit(0).cast("long").alias("ordinal"), F.lit("message").alias("entry_kind"), F.lit("unknown").alias("actor"), F.lit(None).cast("string").alias("timestamp"), "text", F.lit("unknown").alias("origin")),
    }


def _events(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    key = [F.lit("event").alias("source_kind"), F.lit("testdata").alias("instance_id"), F.col("user_id").cast("string").alias("native_id")]
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = raw.select(*key, "user_id", "event_type", C.canonical_timestamp(F.col("ts")).alias("timestamp"), F.concat_ws(" ", "event_type", "props").alias("text"), (F.row_number().over(order) - 1).cast("long").alias("ordinal"))
    # Every fourth entry is a tool's call and the one two later a result, of that call or of the user's first.
    call, result = F.col("ordinal") % 4 == 1, F.col("ordinal") % 4 == 3
    related = F.when(F.col("user_id") % 10 == 0, F.lit(1).cast("long")).otherwise(F.col("ordinal") - 2)
    heads = raw.groupBy(*key, "user_id").agg(C.canonical_timestamp(F.min("ts")).alias("created_at"), C.canonical_timestamp(F.max("ts")).alias("updated_at"))
    return {
        "heads": heads.select(*C.ID, F.col("user_id").alias("n"), F.concat(F.lit("User "), F.col("native_id")).alias("title"), F.lit("events").alias("workspace"), "created_at", "updated_at"),
        "entries": rows.select(
            *C.ID,
            "ordinal",
            F.when(call, "tool-call").when(result, "tool-result").otherwise(F.col("event_type")).alias("entry_kind"),
            F.when(call, "model").when(result, "tool").otherwise("system").alias("actor"),
            "timestamp",
            "text",
            F.when(call, "model").when(result, "tool").otherwise("system").alias("origin"),
            F.when(result, related).alias("related_ordinal"),
            F.when(call, F.concat(F.lit("call-"), F.col("ordinal").cast("string"))).when(result, F.concat(F.lit("call-"), related.cast("string"))).alias("tool_call_id"),
            F.when(call, F.col("event_type")).alias("tool_name"),
            F.when(call, F.lit("events")).alias("tool_namespace"),
        ),
    }


def _relations(heads: DataFrame) -> DataFrame:
    """A user's edges: low confidence where u mod 25 is 0; to a user that isn't there where u mod 40 is 39; to the neighbour and back for 48 and 49 mod 50."""
    u = F.col("n")
    first = F.when(u % 40 == 39, F.lit("9999")).when(u % 50 == 48, (u + 1).cast("string")).when(u % 50 == 49, (u - 1).cast("string")).otherwise(F.floor(u / 2).cast("string"))
    edge = lambda at, kind, to: F.struct(F.lit(at).cast("long").alias("ordinal"), F.lit(kind).alias("relation"), to.alias("to"))
    second = F.floor(u / 3).cast("string")
    edges = F.when((u % 12 == 6) & (u > 6), F.array(edge(0, "parent", first), edge(1, "fork", second))).otherwise(F.array(edge(0, "parent", first)))
    return heads.where((F.col("source_kind") == "event") & (u > 1) & (u % 17 != 0)).select(*C.ID, u.alias("n"), F.explode(edges).alias("e")).select(
        *C.ID,
        F.col("e.ordinal").alias("ordinal"),
        F.col("e.relation").alias("relation"),
        F.lit("event").alias("target_kind"),
        F.lit("testdata").alias("target_instance_id"),
        F.col("e.to").alias("target_native_id"),
        F.when(u % 25 == 0, "low").otherwise("high").alias("confidence"),
    )


def _texts() -> F.Column:
    """An entry's texts, in order: a conversation's in two pieces, parted at the first blank."""
    at = F.instr("text", " ")
    two = F.array(F.substring("text", F.lit(1), at - 1), F.substring("text", at + 1, F.char_length("text")))
    return F.when(F.col("text").isNull(), F.array().cast("array<string>")).when((F.col("source_kind") == "conversation") & (at > 0), two).otherwise(F.array("text"))


def _segments(entries: DataFrame) -> DataFrame:
    """A row for each segment: KEY, segment_ordinal, text or content_class and source_type, origin, metadata."""
    told = F.col("source_kind") == "conversation"
    texts = _texts()
    shaped = F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("content_class")))
    omitted = F.struct(F.lit(None).cast("string").alias("text"), F.lit("image").alias("content_class"))
    whole = F.when(told & (F.col("ordinal") % 3 == 2), F.array_append(shaped, omitted)).otherwise(shaped)
    each = entries.select(*C.ID, "ordinal", "origin", F.posexplode(whole).alias("segment_ordinal", "s"))
    is_omitted = F.col("s.content_class").isNotNull()
    return each.select(
        *C.ID,
        "ordinal",
        F.col("segment_ordinal").cast("long").alias("segment_ordinal"),
        F.col("s.text").alias("text"),
        F.col("s.content_class").alias("content_class"),
        F.when(is_omitted, "input-image").alias("source_type"),
        "origin",
        F.lit("high").alias("confidence"),
        F.when(is_omitted, F.create_map(F.lit("entry"), F.col("ordinal").cast("string"))).alias("metadata"),
    )


def library(spark: SparkSession, sf_dir: str) -> Library:
    """All three tables as one library."""
    parts = [make(spark, sf_dir) for make in (_conversations, _documents, _events)]
    heads, entries = parts[0]["heads"], parts[0]["entries"]
    for p in parts[1:]:
        heads = heads.unionByName(p["heads"], allowMissingColumns=True)
        entries = entries.unionByName(p["entries"], allowMissingColumns=True)
    heads = heads.withColumn("lost", F.coalesce("lost", F.lit(False)))
    n, is_document, lost = F.col("n"), F.col("source_kind") == "document", F.col("lost")
    failed = is_document & (n % 7 == 0)
    tracking = heads.select(
        *C.ID,
        *[F.when(~lost, v).alias(c) for c, v in (("last_good_scheme", F.lit("v1")), ("last_good_digest", F.sha2(F.concat(F.lit("g"), F.col("native_id")), 256)), ("last_good_adapter", F.lit("1")))],
        F.lit("v1").alias("latest_scheme"),
        F.sha2(F.concat(F.when(failed, "x").otherwise("g"), F.col("native_id")), 256).alias("latest_digest"),
        F.lit("1").alias("latest_adapter"),
        F.when(failed, "failed").otherwise("succeeded").alias("latest_outcome"),
        F.when(failed, "unreadable").alias("latest_failure"),
        F.when(is_document & (n % 10 == 3), "missing").otherwise("present").alias("presence_status"),
        _day(n + 2).alias("presence_observed_at"),
        F.when(~lost, _day(n + 1)).alias("captured_at"),
        _day(n + 2).alias("last_seen_at"),
    )
    instance = F.regexp_extract("instance_id", r"(\d+)$", 1)
    odd = is_document & (F.when(instance != "", instance.cast("int")).otherwise(0) % 2 == 1)
    sources = heads.select("source_kind", "instance_id").distinct().select(
        "source_kind", "instance_id", F.when(odd, "unknown").otherwise("complete").alias("coverage_status"), F.lit("2024-05-01T00:00:00.000Z").alias("coverage_observed_at")
    )
    kept = heads.where(~lost)
    documents = kept.select(
        *C.ID,
        F.when((F.col("source_kind") == "event") & (n % 10 == 7), "unknown").otherwise("complete").alias("lineage_coverage"),
        "title",
        "workspace",
        "created_at",
        "updated_at",
        F.sha2(F.concat(F.lit("d"), F.col("native_id")), 256).alias("document_digest"),
    )
    locator = F.concat(F.lit("table:"), F.col("source_kind"))
    segments = _segments(entries)
    base = empty(spark)
    made = {
        "sources": sources,
        "tracking": tracking,
        "documents": documents,
        "relations": _relations(kept),
        "entries": entries.withColumns({"locator_uri": locator, "locator_record": F.col("ordinal").cast("string")}),
        "occurrences": segments.withColumn("digest", F.sha2("text", 256)),
        # Of the texts alone: places in conversations, which take a window over all entries, aren't asked for.
        "contents": entries.select(F.explode(_texts()).alias("text")).select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"]),
    }
    shaped = {}
    for name, df in made.items():
        wanted = base[name].schema
        shaped[name] = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    assert set(shaped) <= set(SCHEMAS)
    return base.with_tables(**shaped)


_STORED: dict[tuple[str, str], str] = {}


def stored_library(spark: SparkSession, sf_dir: str, derived: tuple[str, ...] | None = None) -> Library:
    """library() as a Store keeps it, with these derived tables (all of them if none are named); each table is written to the shared folder once for each application."""
    names = tuple(DERIVED) if derived is None else derived
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = shared.fresh_path(spark, "library")
        Store(spark, path).commit(library(spark, sf_dir), derived=names)
        _STORED[key] = path
    return Store(spark, _STORED[key]).derive(names)
