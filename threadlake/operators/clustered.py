"""Whole documents by merging tables that are bucketed and sorted by conversation.

One bucket function over the identity and one number of buckets for all body tables, so
documents, relations, entries and segments of a conversation lie in the same bucket of
each, and are put together bucket by bucket: no row is exchanged. Segments carry their
texts, which the library keeps by digest; that join is paid once, when the copy is made.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import canonical_json
from threadlake.functions import columns as C
from threadlake.operators.library import Library

_ID = "source_kind string, instance_id string, native_id string"
_SEGMENT = ("segment_ordinal", "digest", "text", "content_class", "source_type", "origin", "confidence")
_ENTRY = ("ordinal", "entry_kind", "actor", "timestamp", "related_ordinal", "tool_call_id", "tool_name", "tool_namespace")
_RELATION = ("ordinal", "relation", "target_kind", "target_instance_id", "target_native_id", "confidence")
SCHEMAS = {
    "documents": f"{_ID}, lineage_coverage string, title string, created_at string, updated_at string, document_digest string",
    "relations": f"{_ID}, ordinal long, relation string, target_kind string, target_instance_id string, target_native_id string, confidence string",
    "entries": f"{_ID}, ordinal long, entry_kind string, actor string, timestamp string, related_ordinal long, tool_call_id string, tool_name string, tool_namespace string",
    "segments": f"{_ID}, ordinal long, segment_ordinal long, digest string, text string, content_class string, source_type string, origin string, confidence string",
}
#: The text bytes of a library that one bucket is made for.
BUCKET_BYTES = 256 << 20


@dataclass(frozen=True)
class Clustered:
    """A copy of a library's body tables in a folder, known to the session by table names."""

    spark: SparkSession
    path: str
    buckets: int
    prefix: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int) -> Clustered:
        """The copy in that folder, in this or a later session."""
        prefix = f"clustered_{uuid.uuid4().hex}"
        for name, schema in SCHEMAS.items():
            order = ", ".join([*C.ID, *(c for c in ("ordinal", "segment_ordinal") if f"{c} long" in schema)])
            spark.sql(f"CREATE TABLE {prefix}_{name} ({schema}) USING parquet CLUSTERED BY ({', '.join(C.ID)}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        return cls(spark, path, buckets, prefix)

    @classmethod
    def write(cls, library: Library, path: str, buckets: int | None = None) -> Clustered:
        """Copies the library; without a number of buckets, by its texts' bytes."""
        if buckets is None:
            size = library["contents"].agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
            buckets = min(100_000, max(library.spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
        out = cls.open(library.spark, path, buckets)
        tables = {n: library[n] for n in ("documents", "relations", "entries")} | {"segments": library["occurrences"].join(library["contents"], "digest", "left")}
        for name, df in tables.items():
            names = [f.split(" ")[0] for f in SCHEMAS[name].split(", ")]
            order = [c for c in ("ordinal", "segment_ordinal") if c in names]
            cut = df.select(names).repartition(buckets, *C.ID)  # one file a bucket
            cut.write.bucketBy(buckets, *C.ID).sortBy(*C.ID, *order).mode("append").format("parquet").saveAsTable(f"{out.prefix}_{name}")
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def close(self) -> None:
        """The session forgets the tables; their files stay."""
        for name in SCHEMAS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")

    def nested(self) -> DataFrame:
        """What transcript.nested() gives: header, relations[] and entries[] with content[], each by ordinal."""
        listed = lambda df, fields, name: df.groupBy(*C.ID).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        # An entry's segments are a run of its conversation's, by ordinal: a map hands them over without a join of its own.
        content = self.table("segments").groupBy(*C.ID, "ordinal").agg(F.sort_array(F.collect_list(F.struct(*_SEGMENT))).alias("content"))
        by_entry = content.groupBy(*C.ID).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "content"))).alias("contents"))
        entries, relations = listed(self.table("entries"), _ENTRY, "entries"), listed(self.table("relations"), _RELATION, "relations")
        head = self.table("documents").withColumnRenamed("document_digest", "stored_digest")
        out = head
        for part in (relations, entries, by_entry):
            out = out.join(part.hint("merge"), C.ID, "left")
        whole = F.transform("entries", lambda e: F.struct(*[e[c].alias(c) for c in _ENTRY], F.try_element_at(F.col("contents"), e["ordinal"]).alias("content")))
        return out.withColumn("entries", whole).drop("contents")

    def digests(self) -> DataFrame:
        """ID, document_digest and public_json of every document."""
        return canonical_json.digests(self.nested())
