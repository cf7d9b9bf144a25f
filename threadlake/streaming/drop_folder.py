"""A streaming front end: files that land in a folder are indexed batch by batch.

Each micro-batch of candidates goes through the same run as a batch index; a
batch says nothing about absence, so conversations that it lacks stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlake.functions import columns as C
from threadlake.operators import ingest
from threadlake.operators.library import SCHEMAS
from threadlake.operators.service import Writer
from threadlake.sources import normal

RECORDS = ", ".join(f"{c} string" for c in C.ID) + ", no long, line string"


def follow(
    spark: SparkSession, folder: str, library: str, kind: str, instance: str, normalise: Callable[[str, list], normal.Document], checkpoint: str, at: Callable[[], str], once: bool = False
) -> StreamingQuery:
    """Indexes conversations whose records (Parquet: ID, no, line) land in folder; a replayed batch finds itself unchanged."""
    stream = spark.readStream.schema(RECORDS).parquet(folder)

    def batch(records: DataFrame, _: int) -> None:
        own = records.where((F.col("source_kind") == kind) & (F.col("instance_id") == instance)).persist()
        try:
            if own.take(1):
                indexed(own)
        finally:
            own.unpersist()

    def indexed(own: DataFrame) -> None:
        # The newest version of a conversation is the whole of it: its revision is the digest of its lines.
        lines = F.array_sort(F.collect_list(F.struct("no", F.coalesce("line", F.lit("")).alias("line"))))
        fresh = own.groupBy(*C.ID).agg(F.sha2(F.to_json(lines), 256).alias("digest")).select(*C.ID, F.lit("lines-v1").alias("scheme"), "digest", F.lit("1").alias("adapter"))
        writer = Writer(spark, library)
        stored = writer.store.open()
        candidates = fresh
        if stored is not None:
            rest = stored["tracking"].where((F.col("source_kind") == kind) & (F.col("instance_id") == instance) & (F.col("presence_status") == "present")).join(fresh.select(*C.ID), C.ID, "left_anti")
            candidates = fresh.unionByName(rest.select(*C.ID, *[F.col(f"last_good_{k}").alias(k) for k in ingest.REVISION]))
        heads = spark.createDataFrame([], SCHEMAS["documents"]).select(*C.ID, "title", "workspace", "created_at", "updated_at")
        now = at()
        writer.index_read(kind, instance, candidates, normal.read_documents(own, normalise), heads, f"stream:{kind}", now, now)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
