"""Roots of conversations in the lineage graph.

A conversation's root is known if its coverage is complete, it has no relation of
kind "unknown", all its other relations but "child" have high confidence and
lead to retained conversations whose roots are known and the same, and no cycle
lies above it. Without such relations it is its own root. "child" edges say
nothing about the child's side and are ignored.

Resolution is pointer doubling over the open frontier: in each round every open edge
is replaced by its target's edges or by what the target has settled on, and a node
whose edges all lead to one root, or one of whose ends is bad, leaves the frontier. A
chain of n links takes log2(n) rounds. A round in which no node settles is the last:
what is open then lies in or behind a cycle, as the nodes of an acyclic chain settle
in every round up to its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators.library import Library
from threadlake.sources import shared

_T = ["target_kind", "target_instance_id", "target_native_id"]


def _node(columns: list[str]) -> F.Column:
    return F.struct(*[F.col(c).alias(n) for c, n in zip(columns, C.ID)])


def roots(library: Library) -> DataFrame:
    """source_kind, instance_id, native_id, root (struct of the same, null if unknown) of every retained conversation: as stored, or resolved."""
    stored = library.stored("roots")
    return resolved(library) if stored is None else stored


def resolved(library: Library) -> DataFrame:
    """roots(), resolved from documents and relations."""
    docs, relations = library["documents"], library["relations"]
    edges = relations.where("relation <> 'child'").join(docs.select(*C.ID), C.ID, "left_semi")
    node = docs.groupBy(*C.ID).agg(F.count("*").alias("copies"), F.min("lineage_coverage").alias("coverage"))
    bad_edges = edges.where("relation = 'unknown' OR confidence <> 'high'").select(*C.ID).distinct().withColumn("bad_edge", F.lit(True))
    node = node.join(bad_edges, C.ID, "left").select(_node(C.ID).alias("id"), ((F.col("copies") > 1) | (F.col("coverage") != "complete") | F.coalesce("bad_edge", F.lit(False))).alias("bad"))
    up = edges.select(_node(C.ID).alias("id"), _node(_T).alias("to")).distinct()
    # ends: nodes that a path may end at. state "root" is a good end; "bad" makes everything below unknown.
    ends = node.join(up.select("id").distinct().withColumn("has_up", F.lit(True)), "id", "left").select(
        "id", F.when(F.col("bad"), "bad").when(F.col("has_up").isNull(), "root").otherwise("open").alias("state")
    )
    ends = shared.saved(ends, "lineage-ends")
    paths = up.join(ends.where("state = 'open'").select("id"), "id", "left_semi").join(ends.select(F.col("id").alias("to"), "state"), "to", "left").select("id", "to", F.coalesce("state", F.lit("bad")).alias("state"))
    settled: list[DataFrame] = []
    before = None
    while True:
        paths = shared.saved(paths.distinct(), "lineage-paths")
        frontier = paths.select("id").distinct().count()
        if frontier in (0, before):
            break
        before = frontier
        root = F.when(F.col("state") == "root", F.col("to"))
        each = paths.groupBy("id").agg(F.max(F.col("state") == "open").alias("open"), F.max(F.col("state") == "bad").alias("bad"), F.min(root).alias("low"), F.max(root).alias("high"))
        spoilt = F.col("bad") | F.coalesce(F.col("low") != F.col("high"), F.lit(False))
        each = each.select("id", (F.col("open") & ~spoilt).alias("open"), F.when(~spoilt, F.col("low")).alias("root"))
        settled.append(each.where("NOT open").select("id", "root"))
        # What has settled in this round ends the edges that lead there; every other open edge is then replaced by those of its target.
        still = paths.join(each.where("open").select("id"), "id", "left_semi")
        past = settled[-1].select(F.col("id").alias("to"), F.coalesce("root", "id").alias("end"), F.when(F.col("root").isNull(), "bad").otherwise("root").alias("end_state"))
        now = still.join(past, "to", "left").select("id", F.coalesce(F.when(F.col("state") == "open", F.col("end")), "to").alias("to"), F.coalesce(F.when(F.col("state") == "open", F.col("end_state")), "state").alias("state"))
        onward = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("state").alias("next_state"))
        moved = now.where("state = 'open'").join(onward, "to").select("id", F.col("next").alias("to"), F.col("next_state").alias("state"))
        paths = now.where("state <> 'open'").unionByName(moved)
    if not settled:
        settled.append(paths.select("id", F.col("to").alias("root")))
    out = ends.join(_union(settled).withColumnRenamed("root", "above"), "id", "left").select("id", F.when(F.col("state") == "root", F.col("id")).when(F.col("state") == "open", F.col("above")).alias("root"))
    return out.select("id.*", "root")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def with_root(df: DataFrame, library: Library) -> DataFrame:
    return df.join(roots(library), C.ID, "left")


def support(matching: DataFrame, library: Library) -> DataFrame:
    """How many distinct known roots the matching conversations have, and how many of them have no known root."""
    return with_root(matching.select(*C.ID).distinct(), library).agg(
        F.count_distinct("root").alias("known_roots"), F.count_if(F.col("root").isNull()).alias("unknown_lineage")
    )
