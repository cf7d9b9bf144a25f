"""Merkle manifest of a dataset: one root over all rows, a subroot for each language, and a proof for each row.

The rows of a language are the leaves of a tree, in the order of doc_id; runs of eight
nodes become their parent. The languages' subroots, in order, are the leaves of a tree on
top. Positions come from ranges of rows, so no task holds a language.

The root comes from a sparse forest: an associative monoid whose values are sets of
unresolved nodes, keyed by tree, level and index. As a tree's number of leaves is known,
so is the size of every run of siblings, and a run that is complete becomes its parent at
once. Each range of rows is folded into such a forest, some nodes at each ragged end of
what it holds; neighbours are merged in rounds, and treeReduce merges the rest until one
node is left. Nothing else meets on the driver.

Proofs are handed down in blocks of BLOCK nodes: the siblings above a block come from the
same steps over the blocks' own nodes, a table of 1/BLOCK of the rows, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import ranks, store
from threadlake.llm.ranks import RANGE, SEQ

ARITY = 8
#: Levels that one block of nodes spans, and its nodes.
SPAN = 3
BLOCK = ARITY**SPAN
#: The tree whose leaves are the languages' subroots.
TOP = -1
_LANG = ["has_lang", "lang"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """The number of a tree's nodes at a level."""
    return -(-leaves // ARITY**level)


@dataclass
class Forest:
    """Unresolved nodes of several trees. merge() is associative and commutative, and Forest() is its unit."""

    trees: int = 0
    leaves: dict[int, int] = field(default_factory=dict)
    nodes: dict[tuple[int, int, int], str] = field(default_factory=dict)

    def _count(self, tree: int) -> int:
        return self.trees if tree == TOP else self.leaves[tree]

    def put(self, tree: int, level: int, index: int, value: str) -> None:
        """Adds a node; a run of siblings that it completes becomes their parent, and a tree's root a leaf of the top tree."""
        while True:
            count = width(self._count(tree), level)
            if count == 1 and tree != TOP:
                tree, level, index = TOP, 0, tree
                continue
            self.nodes[tree, level, index] = value
            if count == 1:
                return
            first = index - index % ARITY
            run = [(tree, level, i) for i in range(first, min(first + ARITY, count))]
            if not all(k in self.nodes for k in run):
                return
            value = digest(*[self.nodes.pop(k) for k in run])
            level, index = level + 1, index // ARITY

    def merge(self, other: Forest) -> Forest:
        small, out = sorted((self, other), key=lambda f: len(f.nodes))
        out.trees = out.trees or small.trees
        out.leaves.update(small.leaves)
        for (tree, level, index), value in small.nodes.items():
            out.put(tree, level, index, value)
        # Only what some unresolved node belongs to has to be known further on.
        live = {tree for tree, _, _ in out.nodes}
        out.leaves = {t: n for t, n in out.leaves.items() if t in live}
        return out

    def root(self) -> str:
        (value,) = self.nodes.values()
        return value


def _field(c: str, value: Column | None = None) -> Column:
    """"-" for null, else the number of UTF-8 bytes, a colon and the value."""
    value = (F.col(c) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """has_lang, lang (empty for null), doc_id, leaf, and altered: the leaf after tampering, null where it isn't tampered with."""
    ids = F.col("doc_id").cast("long")
    numbers = {"doc_id": ids, "n_chars": F.col("n_chars").cast("long")}
    made = lambda text: F.sha2(F.concat(*[_field(c, numbers.get(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field("text", text)).cast("binary"), 256)
    hit = F.crc32(ids.cast("string").cast("binary")) % 3 == 0
    text = F.col("text").cast("string")
    return docs.select(
        F.col("lang").isNotNull().alias("has_lang"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        ids.alias("doc_id"),
        made(text).alias("leaf"),
        F.when(hit, made(F.translate(text, _UPPER, _LOWER))).alias("altered"),
    )


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as nodes (RANGE, tree, n, index, value, doc_id, altered), n being the tree's leaves; and the trees: has_lang, lang, n, tree (its rank)."""
    rows = ranks.ranged(leaves(docs), _LANG, ["doc_id", "leaf"], "leaves")
    each = store.saved(ranks.stretches(rows, _LANG), "stretches")
    trees = each.groupBy(*_LANG).agg(F.sum("stretch_rows").alias("n"))
    trees = trees.withColumn("tree", F.row_number().over(Window.orderBy(*_LANG)).cast("long") - 1)
    known = each.withColumn("offset", F.coalesce(F.sum("stretch_rows").over(ranks.earlier(_LANG)), F.lit(0))).drop("stretch_rows").join(trees.hint("merge"), _LANG)
    joined = rows.join(known.hint("merge"), [RANGE, *_LANG])
    at = F.col(SEQ) - F.col("stretch_from") + F.col("offset")
    return joined.select(RANGE, "tree", "n", at.alias("index"), F.col("leaf").alias("value"), "doc_id", "altered"), trees


#: Forests of neighbouring ranges that become one in a round before the last ones are merged.
NEIGHBOURS = 16
_FRAGMENT = f"{RANGE} int, tree long, level int, index long, n long, value string"


def _fragments(trees: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, Forest] = {}
        for b in batches:
            for part, tree, n, index, value in zip(*(b[c].tolist() for c in (RANGE, "tree", "n", "index", "value"))):
                forest = out.get(part) or out.setdefault(part, Forest(trees))
                forest.leaves[tree] = n
                forest.put(tree, 0, index, value)
        rows = [(part, *key, f.leaves.get(key[0], 0), value) for part, f in out.items() for key, value in f.nodes.items()]
        if rows:
            yield pd.DataFrame(rows, columns=[RANGE, "tree", "level", "index", "n", "value"])

    return fold


def root(nodes: DataFrame, trees: int, ranges: int) -> str | None:
    """The root over all trees' nodes (RANGE, tree, n, index, value), of so many ranges; None without any.

    A forest of neighbouring ranges has unresolved nodes at its two ends only, so neighbours are merged
    first; the few forests of the end are merged in any order.
    """

    def forests(rows: Iterable) -> Iterator[tuple[int, Forest]]:
        for r in rows:
            out = Forest(trees, {r["tree"]: r["n"]})
            out.put(r["tree"], r["level"], r["index"], r["value"])
            yield r[RANGE], out

    if not trees:
        return None
    parts = nodes.select(RANGE, "tree", "n", "index", "value").mapInPandas(_fragments(trees), _FRAGMENT).rdd.mapPartitions(forests).reduceByKey(Forest.merge)
    while ranges > NEIGHBOURS:
        parts = parts.map(lambda kv: (kv[0] // NEIGHBOURS, kv[1])).reduceByKey(Forest.merge)
        ranges = -(-ranges // NEIGHBOURS)
    return parts.values().treeReduce(Forest.merge).root()


def _levels(values: list[str], count: int) -> list[list[str]]:
    """The levels of a block, lowest first, up to its one node, or the tree's root if that comes first; count is the tree's nodes at the lowest."""
    out = [values]
    while count > 1 and len(out) <= SPAN:
        values = [digest(*values[i : i + ARITY]) for i in range(0, len(values), ARITY)]
        out.append(values)
        count = width(count, 1)
    return out


def _beside(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a block's node at in its run, level by level."""
    left, right = [], []
    for values in levels[:-1]:
        first = at - at % ARITY
        left.append("".join(values[first:at]))
        right.append("".join(values[at + 1 : first + ARITY]))
        at //= ARITY
    return left, right


_NODE = "tree long, n long, index long, value string"
_PATH = "tree long, index long, subroot string, lefts array<string>, rights array<string>"


def _climbed(block: pd.DataFrame) -> pd.DataFrame:
    """The one node that a block of nodes comes to."""
    block = block.sort_values("index")
    tree, n, at = (int(block[c].iloc[0]) for c in ("tree", "n", "index"))
    (top,) = _levels(block["value"].tolist(), n)[-1]
    return pd.DataFrame({"tree": [tree], "n": [width(n, SPAN)], "index": [at // BLOCK], "value": [top]})


def _handed(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Paths of a block's nodes: their siblings within it, then the block's own path."""
    nodes = nodes.sort_values("index")
    levels, up = _levels(nodes["value"].tolist(), int(nodes["n"].iloc[0])), above.iloc[0]
    paths = [_beside(levels, i) for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "index": nodes["index"], "subroot": up["subroot"], "lefts": [[*p[0], *up["lefts"]] for p in paths], "rights": [[*p[1], *up["rights"]] for p in paths]})


def _proven(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """For a block of rows: the digest of each one's siblings up to the root, and the root folded from its altered leaf, or its own, and those siblings."""
    nodes = nodes.sort_values("index")
    levels, up = _levels(nodes["value"].tolist(), int(nodes["n"].iloc[0])), above.iloc[0]
    higher = list(zip(up["lefts"], up["rights"]))
    tail = "".join(x + y for x, y in higher)
    folded: dict[str, str] = {}
    out = []
    for i, (value, altered) in enumerate(zip(nodes["value"], nodes["altered"])):
        left, right = _beside(levels, i)
        now = altered or value
        for x, y in zip(left, right):
            now = digest(x, now, y)
        if now not in folded:  # the rows that weren't altered come to the same node here
            end = now
            for x, y in higher:
                end = digest(x, end, y)
            folded[now] = end
        out.append((value, up["subroot"], digest(*[x + y for x, y in zip(left, right)], tail), folded[now]))
    return pd.DataFrame(out, columns=["leaf", "subroot", "proof_sha256", "folded_root"]).assign(doc_id=nodes["doc_id"].array)


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"index div {BLOCK}"))


def _down(nodes: DataFrame, above: DataFrame, each, schema: str) -> DataFrame:
    """each() over every block of nodes with the path of the block."""
    below, upper = _with_block(nodes).groupBy("tree", "block"), above.withColumnRenamed("index", "block").groupBy("tree", "block")
    return below.cogroup(upper).applyInPandas(each, schema)


def _above(nodes: DataFrame, most: int, root_paths) -> DataFrame:
    """The path of every block of nodes, of trees of `most` leaves at most; root_paths gives those of the trees' roots (tree, value, step)."""
    steps = [nodes.select("tree", "n", "index", "value")]
    while most > 1:
        grown = _with_block(steps[-1].where("n > 1")).groupBy("tree", "block").applyInPandas(_climbed, _NODE)
        steps.append(store.saved(grown, "nodes"))
        most = width(most, SPAN)
    found = [s.where("n = 1").select("tree", "value", F.lit(k).alias("step")) for k, s in enumerate(steps)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    ends = store.saved(root_paths(found[0]), "root-paths")
    at = lambda k: ends.where(F.col("step") == k).drop("step")
    known = None
    for k in range(len(steps) - 1, 0, -1):
        upper = at(k) if known is None else at(k).unionByName(known)
        known = store.saved(_down(steps[k], upper, _handed, _PATH), "paths")
    return at(0) if known is None else at(0).unionByName(known)


def _top_paths(trees: int):
    """The paths of the trees' roots in the top tree."""
    nothing = F.array().cast("array<string>")

    def make(roots: DataFrame) -> DataFrame:
        top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("index"), "value")
        last = lambda r: r.select("tree", F.lit(0).cast("long").alias("index"), F.col("value").alias("subroot"), nothing.alias("lefts"), nothing.alias("rights"), "step")
        down = _down(top, _above(top, trees, last), _handed, _PATH)
        joined = roots.join(down.select(F.col("index").alias("tree"), "lefts", "rights").hint("merge"), "tree")
        return joined.select("tree", F.lit(0).cast("long").alias("index"), F.col("value").alias("subroot"), "lefts", "rights", "step")

    return make


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    docs has doc_id, text, lang, source and n_chars; other columns are left out. Any of them
    may be null, also lang, whose rows are a tree of their own, the first. A row without a
    doc_id is never tampered with and comes first in its tree; rows that share a doc_id stand
    in the order of their leaves. Rows whose doc_id has a crc32 that 3 divides are folded
    with A-Z of their text lower-cased: they are verified if that changes nothing. An empty
    table gives no rows.
    """
    placed, trees = _placed(docs)
    nodes = store.saved(placed, "placed-leaves")
    sizes = trees.agg(F.count("*").alias("trees"), F.max("n").alias("most")).collect()[0]
    ranges = nodes.agg(F.max(RANGE)).collect()[0][0]
    if not sizes["trees"]:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    whole = root(nodes, sizes["trees"], ranges + 1)
    above = _above(nodes, sizes["most"], _top_paths(sizes["trees"]))
    rows = nodes.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = _down(rows, above, _proven, "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(whole).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
