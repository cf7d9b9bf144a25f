"""Quarantine and cascading release: delivery of conversation turns of which some are faulty until they are repaired.

A conversation's turns are numbered p from 0; turn p arrives at second 7 * p. It waits for
its parent, one or two turns earlier or none, and is tried when both are there. A faulty
turn is quarantined: an attempt fails before its repair, and some later ones do; it is
tried again after 10, 20, 40 and 80 seconds, and dead after the fifth failure. Turns whose
parent is dead or blocked are blocked. Delivered turns are released in the order of their
delivery, and a conversation's state grows with each release.

The dynamic program runs in pandas, grouped by conversation: a task's rows are sorted by
conversation, and each batch replays the conversations that it completes. A conversation
too long for one range of rows is parted where no parent reaches across: before a turn
without parent whose successor doesn't reach over it. Parts replay apart and in any order,
and the releases of such conversations are ranked over all their parts in ranges of
delivery time. Nothing but rows of one range, or of one such part, meets in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import ranks, store
from threadlake.llm.ranks import RANGE, SEQ

STEP_S, RETRY_S, ATTEMPTS = 7, 10, 5
DELIVERED, DEAD, BLOCKED = "delivered", "dead", "blocked"
_CONV = ["has_id", "conv"]
_WRAP = 1 << 64


def _hash(k: int) -> Column:
    """h(k) of a turn; a null number counts as empty."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.crc32(F.concat(F.lit(f"{k}:"), number("conv_id"), F.lit(":"), number("turn")).cast("binary"))


def _drawn(turns: DataFrame) -> DataFrame:
    """What the rules draw for each turn: the parent's distance, faultiness, seconds to repair, and a bit for each attempt that fails by chance; texts are left behind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.crc32(text.cast("binary")).alias("crc"))
    fails = F.lit(0)
    for a in range(1, ATTEMPTS + 1):
        fails = fails + F.when(_hash(a + 2) % 3 == 0, 1 << (a - 1)).otherwise(0)
    return rows.select(
        F.col("conv_id").isNotNull().alias("has_id"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        "crc",
        (_hash(0) % 3).cast("int").alias("back"),
        (_hash(1) % 101 < 35).alias("faulty"),
        (_hash(2) % 101).cast("int").alias("repair"),
        fails.cast("int").alias("fails"),
    )


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with p and part, a part being an independent run of turns; and the conversations' stretches with the part that each begins."""
    of_stretch = Window.partitionBy(RANGE, *_CONV)
    # The turn before which the conversation can be parted: it has no parent, and the next one doesn't reach over it. A stretch's last turn doesn't know the next.
    safe = (F.col("back") == 0) & (F.lead("back").over(of_stretch.orderBy(SEQ)) < 2)
    cut = rows.withColumn("safe", safe).withColumn("cut", F.min(F.when(F.col("safe"), F.col(SEQ))).over(of_stretch)).drop("safe")
    each = ranks.stretches(cut, _CONV, F.min("cut").alias("first_cut"))
    first = F.row_number().over(Window.partitionBy(*_CONV).orderBy(RANGE)) == 1
    begins = F.when(first, F.col("stretch_from")).otherwise(F.col("first_cut"))
    known = each.withColumn("begins", begins).select(
        RANGE,
        *_CONV,
        "begins",
        "stretch_from",
        F.coalesce(F.sum("stretch_rows").over(ranks.earlier(_CONV)), F.lit(0)).alias("offset"),
        F.last(F.when(F.col("begins").isNotNull(), F.col(RANGE)), ignorenulls=True).over(ranks.earlier(_CONV)).alias("running"),
        F.count("begins").over(Window.partitionBy(*_CONV)).alias("parts"),
    )
    joined = cut.drop("cut").join(known.hint("merge"), [RANGE, *_CONV])
    part = F.when(F.col(SEQ) >= F.col("begins"), F.col(RANGE)).otherwise(F.col("running"))
    return joined.select(*_CONV, "has_turn", "turn", "crc", "back", "faulty", "repair", "fails", (F.col(SEQ) - F.col("stretch_from") + F.col("offset")).alias("p"), part.alias("part"), "parts")


_OUT = "has_id boolean, conv long, has_turn boolean, turn long, p long, crc long, parts long, status string, attempts int, first_at long, last_at long, release_no long, state long"


def replayed(rows: pd.DataFrame) -> pd.DataFrame:
    """Every turn's fate, and releases counted within each part. rows: whole parts of conversations, one after another, each by p."""
    p, back, faulty, repair, fails = (rows[c].to_numpy() for c in ("p", "back", "faulty", "repair", "fails"))
    n = len(rows)
    part = _part_numbers(rows)
    # The parent array: an index into these rows, or -1. A part begins where no parent reaches before it.
    parent = np.where((back == 0) | (back > p), -1, np.arange(n) - back).tolist()
    arrival = (p * STEP_S).tolist()
    mended = (p * STEP_S + repair).tolist()
    faulty, fails = faulty.tolist(), fails.tolist()
    first, last, attempts, good = [-1] * n, [-1] * n, [0] * n, [False] * n
    for i in range(n):
        at, up = arrival[i], parent[i]
        if up >= 0:
            if not good[up]:
                continue
            at = max(at, last[up])
        first[i] = at
        for a in range(1, ATTEMPTS + 1):
            if not faulty[i] or (at >= mended[i] and not fails[i] >> (a - 1) & 1):
                good[i] = True
                break
            if a < ATTEMPTS:
                at += RETRY_S << (a - 1)
        last[i], attempts[i] = at, a
    first, last, attempts, good = np.array(first, np.int64), np.array(last, np.int64), np.array(attempts, np.int32), np.array(good, bool)
    tried = attempts > 0
    order = np.lexsort((p, last, part))
    released = order[good[order]]
    number, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
    number[released] = _since(part[released], np.ones(len(released), np.int64))
    state[released] = _since(part[released], number[released] * rows["crc"].to_numpy()[released])
    return pd.DataFrame(
        {
            **{c: rows[c].array for c in (*_CONV, "has_turn", "turn", "p", "crc", "parts")},
            "status": np.where(good, DELIVERED, np.where(tried, DEAD, BLOCKED)),
            "attempts": attempts,
            **{c: pd.arrays.IntegerArray(v, ~there) for c, v, there in (("first_at", first, tried), ("last_at", last, tried), ("release_no", number, good), ("state", state, good))},
        }
    )


def _part_numbers(rows: pd.DataFrame) -> np.ndarray:
    """0, 1, ... for the runs of rows of one conversation and part."""
    new = np.zeros(len(rows), bool)
    for c in (*_CONV, "part"):
        v = rows[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _since(part: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Cumulative sums of values that begin anew with each part (64 bits, wrapping)."""
    total = np.cumsum(values)
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    return total - np.repeat(total[begins] - values[begins], np.diff(np.r_[begins, len(part)]))


def _each_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """replayed() over a sorted partition, batch by batch: a batch's last part waits for the next one."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        part = _part_numbers(batch)
        at = int(np.searchsorted(part, part[-1]))
        if held and (at or any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in (*_CONV, "part"))):
            yield replayed(pd.concat([*held, batch.iloc[:at]], ignore_index=True))
            held = []
        elif at:
            yield replayed(batch.iloc[:at])
        held.append(batch.iloc[at:])
    if held:
        yield replayed(pd.concat(held, ignore_index=True))


def _whole_releases(turns: DataFrame) -> DataFrame:
    """The turns of conversations of several parts, with release_no and state over all of them."""
    good = turns.where(F.col("status") == DELIVERED)
    rows = ranks.ranged(good, _CONV, ["last_at", "p"], "releases")
    whole = lambda c: c.cast("decimal(38,0)")
    each = ranks.stretches(rows, _CONV, F.sum(whole(F.col("crc"))).alias("crcs"), F.sum(whole(F.col(SEQ)) * F.col("crc")).alias("weighed"))
    before = ranks.earlier(_CONV)
    offset = F.coalesce(F.sum("stretch_rows").over(before), F.lit(0))
    own = F.col("weighed") + (1 - F.col("stretch_from") + F.col("offset")) * F.col("crcs")
    known = each.withColumn("offset", offset).withColumn("own", whole(own)).withColumn("base", F.coalesce(F.sum("own").over(before), whole(F.lit(0))))
    placed = rows.join(known.select(RANGE, *_CONV, "stretch_from", "offset", "base").hint("merge"), [RANGE, *_CONV])
    number = F.col(SEQ) - F.col("stretch_from") + F.col("offset") + 1
    running = F.sum(whole(number) * F.col("crc")).over(Window.partitionBy(RANGE, *_CONV).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0))
    half, turn = whole(F.lit(str(_WRAP >> 1))), whole(F.lit(str(_WRAP)))
    state = F.pmod(whole(running + F.col("base") + half), turn) - half
    released = placed.withColumns({"release_no": number, "state": state.cast("long")}).select(turns.columns)
    return released.unionByName(turns.where(F.col("status") != DELIVERED))


def replay(turns: DataFrame) -> DataFrame:
    """conv_id, turn, p, status, attempts, first_at, last_at, release_no and state of every turn.

    turns has conv_id, turn and text; other columns are left out. first_at and last_at are the
    seconds of the first and last attempt, null for a blocked turn; release_no (from 1, by
    last_at, then p) and state (the sum of release_no * crc32 of the text's UTF-8) are null unless
    it is delivered. A null text counts as empty. Rows without a conv_id are one conversation;
    a null turn comes first in its own, and null numbers are hashed as empty. Rows that share
    a turn are turns of their own, in the order of their text's crc32. A state is kept to
    64 bits (it wraps beyond). An empty table gives no rows.
    """
    rows = ranks.ranged(_drawn(turns), _CONV, ["has_turn", "turn", "crc"], "turns")
    parts = _parts(rows).repartition(*_CONV, "part").sortWithinPartitions(*_CONV, "part", "p")
    done = store.saved(parts.mapInPandas(_each_part, _OUT), "replayed")
    several = F.col("parts") > 1
    whole = done.where(~several).unionByName(_whole_releases(done.where(several)))
    return whole.select(F.when(F.col("has_id"), F.col("conv")).alias("conv_id"), F.when(F.col("has_turn"), F.col("turn")).alias("turn"), "p", "status", "attempts", "first_at", "last_at", "release_no", "state")
