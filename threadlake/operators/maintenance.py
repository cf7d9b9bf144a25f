"""Forgetting, garbage collection, and differences between projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import columns as C
from threadlake.operators import ingest
from threadlake.operators.library import Delta, Library
from threadlake.plans.requests import OperationError
from threadlake.sources import shared


def orphans(library: Library) -> DataFrame:
    """Contents that no occurrence refers to."""
    return library["contents"].join(library["occurrences"].select("digest").where("digest IS NOT NULL").distinct(), "digest", "left_anti")


def orphan_counts(library: Library) -> DataFrame:
    return orphans(library).agg(F.count("*").alias("orphan_rows"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("orphan_bytes"))


def repair_orphans(library: Library) -> Library:
    """The library without texts that no occurrence refers to."""
    gone = orphans(library).select("digest")
    return library.with_tables(Delta({}, dropped=gone), contents=ingest.referenced(library))


#: A window of a bounded repair: so many orphans at most, and so many bytes of them, the text that passes the mark included.
WINDOW_ROWS, WINDOW_BYTES = 1_000_000, 16 << 30
#: Digests are added up by so many first hex digits, so no task sees more than one of 65,536 parts of the orphans in order.
HEAD = 4


def orphans_between(library: Library, after: str = "", last: str | None = None) -> DataFrame:
    """orphans() whose digest is above `after` and not above `last`; the bounds reach both scans, which are sorted by digest where they are stored."""
    kept = library.stored("places")
    used = (library["occurrences"].where("digest IS NOT NULL") if kept is None else kept).select("digest")
    within = F.col("digest") > after
    if last is not None:
        within = within & (F.col("digest") <= last)
    return library["contents"].where(within).join(used.where(within), "digest", "left_anti")


def windows(library: Library, after: str = "", rows: int = WINDOW_ROWS, size: int = WINDOW_BYTES) -> DataFrame:
    """How orphans above `after` are cut into windows: last (the window's last digest), rows and bytes.

    Windows follow each other by digest. One ends where the number of orphans so far passes a multiple of
    `rows` or their bytes pass one of `size`; the sums are those within a head plus the totals of the heads before.
    """
    lost = orphans_between(library, after).select("digest", F.octet_length("text").cast("long").alias("bytes"), F.substring("digest", 1, HEAD).alias("head"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** HEAD rows at most
    heads = lost.groupBy("head").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    heads = heads.select("head", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "b")])
    inside = Window.partitionBy("head").orderBy("digest")
    earlier = F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = lost.join(heads, "head").select(
        "digest",
        "bytes",
        F.floor((F.col("n") + F.row_number().over(inside) - 1) / rows).alias("by_rows"),
        F.floor((F.col("b") + F.coalesce(earlier, F.lit(0))) / size).alias("by_size"),
    )
    cut = placed.groupBy("by_rows", "by_size").agg(F.max("digest").alias("last"), F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    return cut.select("last", "rows", "bytes")


def repair_between(library: Library, after: str, last: str) -> Library:
    """The library without the orphans of one window."""
    gone = orphans_between(library, after, last).select("digest")
    return library.with_tables(Delta({}, dropped=gone), contents=library["contents"].join(gone, "digest", "left_anti").select("digest", "text"))


def forget(library: Library, identity: tuple[str, str, str]) -> Library:
    """Takes a conversation out of every table, with its contents that nothing else refers to; run items count it as omitted."""
    this = F.struct(*C.ID) == F.struct(*[F.lit(v).alias(c) for c, v in zip(C.ID, identity)])
    if not library["tracking"].where(this).take(1):
        raise OperationError("conversation-not-found", "the library has no such conversation")
    lost = library["run_items"].where(this).groupBy("run_id").agg(F.count("*").alias("lost"))
    runs = library["runs"].join(lost, "run_id", "left").withColumn("omitted_items", F.col("omitted_items") + F.coalesce("lost", F.lit(0)))
    whole = {"tracking": library["tracking"].where(~this), "run_items": library["run_items"].where(~this), "runs": runs.select(library["runs"].columns)}
    bodies = {n: library[n].where(~this) for n in ("documents", "relations", "entries", "occurrences")}
    dropped = ingest.unreferenced(library["occurrences"].where(this), bodies["occurrences"])
    contents = library["contents"].join(dropped, "digest", "left_anti").select("digest", "text")
    removed = library.spark.createDataFrame([identity], ", ".join(f"{c} string" for c in C.ID))
    return library.with_tables(Delta(whole, removed, None, dropped), **whole, **bodies, contents=contents)


#: Ranges of keys that are compared as a whole before their rows are.
RANGES = 4096


def _range(key: str):
    return F.pmod(F.xxhash64(key), F.lit(RANGES)).cast("int")


def _halves(names: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row, by halves, whose sums don't depend on the order of rows."""
    told = [*names, *[F.col(c).isNull() for c in names]]  # a hash passes over nulls
    hashes = [F.xxhash64(F.lit(0), *told), F.xxhash64(F.lit(1), *told)]
    return [f(h) for h in hashes for f in (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32))]


def range_digests(rows: DataFrame, key: str) -> DataFrame:
    """A digest for each range of key values that doesn't depend on the order of rows, nor forgets repeats: their number, and sums of two 64-bit hashes by halves. Nothing but these is shuffled."""
    return rows.groupBy(_range(key).alias("range")).agg(F.count("*").alias("rows"), *[F.sum(h).alias(f"sum_{i}") for i, h in enumerate(_halves(rows.columns))])


def key_differences(rows: DataFrame, left: Column, right: Column, key: str) -> DataFrame:
    """side, key and n: how many rows of a key, with repeats, one side has and the other lacks, as difference() of two parts of one table has them; the parts are told by conditions on its rows.

    Each key's rows are counted and digested where they are read, so a row for a key is shuffled. That is all of a key
    which one side alone has, or both alike; only rows of keys that differ otherwise are compared one by one.
    """
    halves, sides = _halves([c for c in rows.columns if c != key]), {"left": left, "right": right}
    sums = [F.sum(F.when(c, h)).alias(f"{side}_{i}") for side, c in sides.items() for i, h in enumerate(halves)]
    each = rows.groupBy(key).agg(*[F.count_if(c).alias(side) for side, c in sides.items()], *sums)
    same = F.col("left") == F.col("right")
    for i in range(len(halves)):
        same = same & F.col(f"left_{i}").eqNullSafe(F.col(f"right_{i}"))
    odd = shared.saved(each.where(~same).select(key, "left", "right"), "odd-keys")
    alone = odd.where((F.col("left") == 0) | (F.col("right") == 0))
    out = alone.select(F.when(F.col("left") > 0, "left").otherwise("right").alias("side"), key, F.greatest("left", "right").alias("n"))
    both = odd.where("left > 0 AND right > 0").select(F.col(key).alias("odd_key"))
    if both.take(1):
        mixed = rows.join(both, F.col(key).eqNullSafe(F.col("odd_key")), "left_semi")
        out = out.unionByName(difference(mixed.where(left), mixed.where(right)).groupBy("side", key).agg(F.count("*").alias("n")))
    return out


def changed_ranges(left: DataFrame, right: DataFrame, key: str) -> list[int]:
    """The ranges whose digests differ: RANGES numbers at most."""
    x, y = range_digests(left, key), range_digests(right.select(left.columns), key)
    names = x.columns[1:]
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
    found = x.alias("x").join(y.alias("y"), F.col("x.range") == F.col("y.range"), "full").where(~same)
    return sorted(r[0] for r in found.select(F.coalesce("x.range", "y.range")).collect())


def difference(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    """Rows, with repeats, that one side has and the other lacks: side says which has them. Empty if both are equal.

    With a key, ranges of its values are compared by digest first, and only the rows of those that differ one by one.
    """
    names = left.columns
    right = right.select(names)
    if key is not None:
        ranges = changed_ranges(left, right, key)
        if not ranges:
            return left.limit(0).withColumn("side", F.lit("left"))
        left, right = (df.where(_range(key).isin(ranges)) for df in (left, right))
    # Both directions from one count of each row: how many more the left side has.
    more = "more"
    while more in names:
        more += "_"
    both = left.withColumn(more, F.lit(1)).unionByName(right.withColumn(more, F.lit(-1)))
    odd = both.groupBy(*names).agg(F.sum(more).alias(more)).where(F.col(more) != 0)
    side = F.when(F.col(more) > 0, "left").otherwise("right").alias("side")
    return odd.select(*names, side, F.explode(F.array_repeat(F.lit(0), F.abs(more).cast("int"))).alias(more)).drop(more)
