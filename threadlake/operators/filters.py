"""Filters of requests as column conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.plans.requests import ConversationFilter, EntryFilter


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def conversations(f: ConversationFilter) -> Column:
    """Over the columns of Library.spine(); a null time satisfies no bound."""
    exact = {"source_kind": f.source, "instance_id": f.instance, "native_id": f.native_id, "source_state": f.source_state, "workspace": f.workspace}
    conditions = [F.col(c) == v for c, v in exact.items() if v is not None]
    if f.conversation is not None:
        conditions += [F.col(c) == v for c, v in zip(C.ID, f.conversation)]
    for column, after, before in (
        ("activity", f.activity_after, f.activity_before),
        ("captured_at", f.captured_after, f.captured_before),
        ("observed_at", f.observed_after, f.observed_before),
    ):
        conditions += [F.col(column) > after] if after is not None else []
        conditions += [F.col(column) < before] if before is not None else []
    return _all(conditions)


def entries(f: EntryFilter) -> Column:
    """Over the columns of the entries table; a tool filter means tool calls. Origin isn't here: it holds for segments."""
    conditions = []
    for column, value in (("actor", f.actor), ("entry_kind", f.entry_kind), ("tool_name", f.tool_name), ("tool_namespace", f.tool_namespace)):
        conditions += [F.col(column) == value] if value is not None else []
    if f.tool_name is not None or f.tool_namespace is not None:
        conditions.append(F.col("entry_kind") == "tool-call")
    conditions += [F.col("timestamp") > f.entry_after] if f.entry_after is not None else []
    conditions += [F.col("timestamp") < f.entry_before] if f.entry_before is not None else []
    return _all(conditions)


def with_origin(selected: DataFrame, occurrences: DataFrame, origin: str | None) -> DataFrame:
    """Entries with any segment, omitted ones too, of that origin; an entry without segments has none."""
    if origin is None:
        return selected
    keys = occurrences.where(F.col("origin") == origin).select(*C.ID, "ordinal").distinct()
    return selected.join(keys, [*C.ID, "ordinal"], "left_semi")
