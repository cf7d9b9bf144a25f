"""Positions of rows within ordered groups of any size, without one task for a group.

Rows are cut into ranges of (group, order), each sorted by one task, so a group that
holds a third of all rows spans many ranges. What crosses ranges is one row for each
(range, group): its number of rows and where it begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import store

#: Columns that ranged() adds: the range, and the row's place in it from 0.
RANGE, SEQ = "range_no", "range_seq"
#: monotonically_increasing_id() counts rows of a partition in its low 33 bits.
_LOW = (1 << 33) - 1


def ranged(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """df in ranges of (group, order), nulls first, with RANGE and SEQ; written to the shared folder, so both stay as they are.

    The bounds of ranges are drawn from a pass of its own over the rows, so they are written first: what they are made of is read once.
    """
    by = [F.asc_nulls_first(c) for c in [*group, *order]]
    once = store.saved(df, label)
    cut = once.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    placed = cut.withColumn("range_at", at).withColumns({RANGE: F.shiftright("range_at", 33).cast("int"), SEQ: F.col("range_at").bitwiseAND(F.lit(_LOW))})
    out = store.saved(placed.drop("range_at"), label)
    store.drop(once)
    return out


def stretches(rows: DataFrame, group: list[str], *more) -> DataFrame:
    """One row for each RANGE and group: stretch_rows, stretch_from (the first SEQ) and the aggregates in more."""
    return rows.groupBy(RANGE, *group).agg(F.count("*").alias("stretch_rows"), F.min(SEQ).alias("stretch_from"), *more)


def earlier(group: list[str]):
    """The window of a group's stretches in ranges before this one; a group has a stretch a range at most."""
    return Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
