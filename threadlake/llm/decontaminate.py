"""Benchmark decontamination: which documents contain which test items.

An item is in a document if the document has at least `containment` of the item's
distinct word shingles. Search, then proof:

* Items are partitioned by the size of their shingle set (powers of two). Of an
  item of a partition whose largest set has q shingles, the MinHash sketch keeps
  the k = floor((1 - containment) q) + 1 shingles of least hash. A document that
  lacks all k of them lacks more than (1 - containment) of the item, so no
  document above the threshold is missed, however long it is; documents need no
  sketch of their own, so their length doesn't blur the estimate.
* Documents stream past the sketches (hash of each shingle, one equi-join).
* Each (document, item) found is proven on the words themselves.

Sketches and items are broadcast only up to BROADCAST_ROWS rows; beyond that the
same joins shuffle. No step gathers a document's or an item's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import store
from threadlake.llm import text_sql as T

CONTAINMENT = 0.75
#: At most so many rows of 16 bytes (sketches, candidate ids) or of an item's text are broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_ITEMS = 20_000


def _bounded(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_key, width, h: the bottom-k sketch of each item, k by the largest set of its size partition."""
    sized = items.withColumn("size_class", F.ceil(F.log2("n_item")).cast("int"))
    largest = sized.groupBy("size_class").agg(F.max("n_item").alias("q"))
    keep = F.floor(F.lit(1.0 - containment) * F.col("q") + 1e-9).cast("int") + 1
    hashed = F.array_sort(F.array_distinct(F.transform("shingles", lambda s: _hash_of(s))))
    return (
        sized.join(F.broadcast(largest), "size_class")
        .select("item_key", "width", F.explode(F.slice(hashed, F.lit(1), keep)).alias("h"))
    )


def _hash_of(shingle):
    """The hash that a document's run of the same words gets: it is taken over the words one by one."""
    parts = F.split(shingle, " ")
    by_width = F.xxhash64(F.get(parts, F.lit(0)))
    for w in range(2, T.SHINGLE + 1):
        by_width = F.when(F.size(parts) >= w, F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(w)])).otherwise(by_width)
    return by_width


def find(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document and item found: doc_id, item_id, n_item, n_found, containment.

    docs has doc_id and text, benchmark item_id and text; other columns are left out.
    Null or empty texts contain nothing and are in nothing; rows with a null id
    can't be named and are left out. An item of fewer than five words is one
    shingle of all its words. Repeated rows count once: where an id stands on
    several rows, the fullest match is returned. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = (
        benchmark.where(F.col("item_id").isNotNull())
        .select(F.col("item_id").alias("item_id"), T.words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("shingles", T.shingle_texts(F.col("words")))
        .select(
            "item_id",
            F.xxhash64("item_id", F.array_join("words", " ")).alias("item_key"),
            F.least(F.size("words"), F.lit(T.SHINGLE)).alias("width"),
            F.size("shingles").alias("n_item"),
            "shingles",
        )
        .dropDuplicates(["item_key"])
    )
    items = store.saved(items, "items")
    n_items = items.count()
    sketches = store.saved(item_sketches(items, containment), "sketches")
    n_sketches = sketches.count()

    spoken = docs.select("doc_id", T.words(F.col("text")).alias("words"))
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # five values at most
    candidates = None
    for width in widths or [T.SHINGLE]:
        runs = spoken.select("doc_id", F.explode(T.shingle_hashes(F.col("words"), width)).alias("h"))
        wanted = sketches.where(F.col("width") == width).select("h", "item_key")
        found = runs.join(_bounded(wanted, n_sketches, BROADCAST_ROWS), "h").select("doc_id", "item_key")
        candidates = found if candidates is None else candidates.unionByName(found)
    candidates = store.saved(candidates.distinct(), "candidates")
    n_candidates = candidates.count()

    padded = F.concat(F.lit(" "), F.array_join(T.words(F.col("text")), " "), F.lit(" ")).alias("padded")
    pairs = (
        docs.join(_bounded(candidates, n_candidates, BROADCAST_ROWS), "doc_id")
        .select("doc_id", "item_key", padded)
        .join(_bounded(items, n_items, BROADCAST_ITEMS), "item_key")
    )
    n_found = F.size(F.filter("shingles", lambda s: F.contains(F.col("padded"), F.concat(F.lit(" "), s, F.lit(" ")))))
    proven = pairs.select("doc_id", "item_id", "n_item", n_found.alias("n_found")).where(F.col("n_found") >= F.lit(containment) * F.col("n_item"))
    best = F.max(F.struct((F.col("n_found") / F.col("n_item")).alias("containment"), "n_item", "n_found")).alias("best")
    return proven.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.n_item").cast("long").alias("n_item"), F.col("best.n_found").cast("long").alias("n_found"), "best.containment")


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that contain no item; every column stays, and so do rows without an id."""
    ids = store.saved(leaks.select("doc_id").distinct(), "leaks")
    return docs.join(_bounded(ids, ids.count(), BROADCAST_ROWS), "doc_id", "left_anti").select(docs.columns)
