"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS arcs of equal length. Every shard owns `vnodes` points on it;
a row hashes to a cell and belongs to the first point at or after it, clockwise.
Loads are bounded: a shard takes no more than its capacity. In each round, the
rows still without a place offer themselves to the shard of their current point;
a shard with too little room takes them in clockwise order of cell (and by hash
within a cell), and the others go on clockwise, past full shards. Rows that a
shard has taken are never moved again, so only overflow moves.

All rows of a cell see the same points, so the rounds need only the number of
rows in each cell: CELLS counts at most, whatever the table's size. The result
is a short list of rank ranges per cell, and a row finds its shard and slot from
its rank within its cell.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_BITS = 14
CELLS = 1 << CELL_BITS
VNODES = 128


@dataclass(frozen=True)
class Share:
    """Ranks low .. high - 1 of a cell: they fill the shard's slots from base on."""

    cell: int
    low: int
    high: int
    shard: int
    base: int


def points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; a shard's points don't depend on how many others there are."""
    out = []
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            out.append((int.from_bytes(h, "big") >> (64 - CELL_BITS), int.from_bytes(h, "big"), s))
    return [(cell, s) for cell, _, s in sorted(out)]


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Without slack the capacities add up to the rows and are at most one apart; else each is (1 + slack) times the mean, rounded up."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allot(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[Share]:
    """Places the rows of every cell."""
    ring = points(shards, vnodes)
    cells = [c for c, _ in ring]
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    out: list[Share] = []
    # (cell, first rank without a place, end, index of the current point)
    waiting = [(c, 0, n, bisect.bisect_left(cells, c) % len(ring)) for c, n in sorted(counts.items()) if n]
    while waiting:
        rest = []
        for cell, low, high, at in waiting:
            while not room[ring[at][1]]:
                at = (at + 1) % len(ring)
            rest.append((cell, low, high, at))
        waiting = []
        for cell, low, high, at in rest:
            shard = ring[at][1]
            take = min(room[shard], high - low)
            if take:
                out.append(Share(cell, low, low + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if low + take < high:
                waiting.append((cell, low + take, high, (at + 1) % len(ring)))
    return out


def assign(docs: DataFrame, shards: int = 24, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    docs has doc_id and text; other columns are left out. size is the text's UTF-8
    bytes plus 8. A null text counts as empty. A row hashes by its doc_id, or by its
    text where doc_id is null; repeated rows are rows of their own, each with its
    own slot. Without slack, shards differ by one row at most. An empty table gives
    no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(text)).alias("h"),
    ).withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int"))
    spark = docs.sparkSession
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shares = [(s.cell, s.low, s.high, s.shard, s.base) for s in allot(counts, shards, vnodes, slack)]
    plan = F.broadcast(spark.createDataFrame(shares, "cell int, low long, high long, shard int, base long"))  # CELLS + shards rows or so
    rank = (F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")) - 1).cast("long")
    ranked = rows.withColumn("rank", rank)
    return (
        ranked.join(plan, (ranked["cell"] == plan["cell"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))
    )
