"""Exact dedup against a persistent index of digests, bucketed and sorted by digest.

The index is a table of one row for each distinct text that was ever let in: its digest,
the row that stays and the batch that brought it. New data is reduced to its distinct
digests, salted first so that one text may make up a third of the rows, and what the index
has already is taken out by a sort-merge anti-join: the index is read bucket by bucket and
isn't shuffled. The rest is appended, bucketed and sorted the same way. The first batch
that has a text decides which row stays, so adding a batch again changes nothing.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import store

#: An index has so many buckets at least, and one for so many rows that it is made for.
BUCKETS, BUCKET_ROWS = 64, 4_000_000
_SCHEMA = "text_sha256 string, keep_id long, batch string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of the text with A-Z lower-cased (null: empty), and salt, by which the rows of one digest are spread over all tasks; written once."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(store.partitions_of(docs.sparkSession))).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    # Without a doc_id rows are spread at random; the written table holds the draw.
    return store.saved(rows.withColumn("salt", F.when(F.col("doc_id").isNotNull(), salt).otherwise(F.floor(F.rand(7) * store.partitions_of(docs.sparkSession)).cast("int"))), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """text_sha256, keep_id (largest doc_id, null if none has one) and group_size of hashed rows, in two steps: by salt, then over salts."""
    parts = rows.groupBy("text_sha256", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return parts.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


@dataclass(frozen=True)
class DigestIndex:
    """A folder with an index, known to the session under a table name."""

    spark: SparkSession
    path: str
    buckets: int
    name: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> DigestIndex:
        """The index in that folder, in this or a later session; a new one where it is empty. buckets stays as the index was made with."""
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({_SCHEMA}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'")
        return cls(spark, path, buckets, name)

    def table(self) -> DataFrame:
        """text_sha256, keep_id, batch."""
        return self.spark.table(self.name)

    def unknown(self, digests: DataFrame) -> DataFrame:
        """The rows of digests (text_sha256, ...; one row each) that the index lacks."""
        return digests.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Appends the texts of hashed rows that the index lacks; of equal ones the row of largest doc_id."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch's name has letters, digits, dots and dashes: {batch!r}")
        new = self.unknown(grouped(rows)).select("text_sha256", "keep_id", F.lit(batch).alias("batch"))
        # The anti-join reads the table that the append writes to, so its result is a table first.
        ready = store.saved(new, "new-digests")
        ready.repartition(self.buckets, "text_sha256").write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").format("parquet").saveAsTable(self.name)
        store.drop(ready)

    def compact(self, to: str) -> DigestIndex:
        """The same index in another folder, one sorted file a bucket: many small batches leave as many files in each."""
        out = DigestIndex.open(self.spark, to, self.buckets)
        self.table().repartition(self.buckets, "text_sha256").write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").format("parquet").saveAsTable(out.name)
        return out

    def close(self) -> None:
        """The session forgets the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def judged(self, rows: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size (among these rows), kept and text_sha256 of hashed rows whose texts are all in the index.

        A row is kept if it is the one that the index names; so is every row without a doc_id
        of a text that no row with one has, as those can't be told apart.
        """
        groups = grouped(rows).drop("keep_id").join(self.table().select("text_sha256", "keep_id").hint("merge"), "text_sha256")
        # One row for each (digest, salt) that there is takes the verdict to the salted rows.
        salted = rows.select("text_sha256", "salt").distinct().join(groups.hint("merge"), "text_sha256")
        joined = rows.join(salted.hint("merge"), ["text_sha256", "salt"])
        kept = F.when(F.col("keep_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
        return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, batches: int = 2, path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; of equal texts the row of largest doc_id stays.

    docs has doc_id and text; other columns are left out. Texts are equal when they are after
    lower-casing A-Z only; null counts as empty. The documents enter a new index (in path, or
    the shared folder) in batches of falling doc_id, rows without one last, so the first row
    of a text that the index lets in is the one that stays. Rows that share doc_id and text
    stay or go together, and each counts. An empty table gives no rows.
    """
    rows = hashed(docs)
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).collect()[0]
    low, high = ends["low"] or 0, ends["high"] or 0
    index = DigestIndex.open(docs.sparkSession, path or store.fresh_path(docs.sparkSession, "digest-index"), max(BUCKETS, ends["n"] // BUCKET_ROWS))
    above = F.lit(True)
    for k in range(batches, 0, -1):
        least = low + (high - low + 1) * (k - 1) // batches
        inside = (F.col("doc_id") >= least) if k > 1 else F.lit(True)
        index.add(rows.where(above & inside), f"batch-{batches - k}")
        above = F.coalesce(F.col("doc_id") < least, F.lit(True))
    return index.judged(rows)
