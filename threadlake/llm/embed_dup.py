"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction, and a vector belongs to it if their inner product
exceeds a threshold. The directions are structured random product codes: a
rotated space is cut into blocks with random codewords each, and every
combination of one codeword a block is a direction; there are CODES such codes. A
vector is list-decoded: the sorted inner products with half-codes give all
directions that exceed its threshold without a visit to the others. The threshold
lies a fixed margin below the vector's largest inner product: one for all would
give some vectors hundreds of filters and others none. All directions above it
are taken, however many. A margin of twice the distance of two vectors at COSINE
would make the search exact, as the best direction of one would then always exceed
the other's threshold; with margin(), more than 0.985 of pairs at COSINE are found
from 2 to 1,024 components. Vectors are joined on the filters they share, and
cosines are computed in double precision.

A filter's bucket is never expanded into pairs of rows. It is cut into tiles of
TILE vectors at most; a task multiplies two tiles, counts each vector's links and
emits the counts and a spanning forest. A pair that shares several filters is
counted at the smallest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm import store
from threadlake.llm.components import components

COSINE = 0.95
CODES = 2
#: The margin in deviations of a direction's inner product; the tests measure the recall from 2 to 1,024 components.
DEVIATIONS = 0.25
TILE = 1024
#: Inner products this close to the threshold are worked out anew, so that a link doesn't depend on who else is in a tile.
DOUBT = 1e-9
#: The largest finite double.
MOST = float(np.finfo(np.float64).max)
_SEED = 7


def shape(dim: int) -> tuple[int, int]:
    """Blocks and codewords of the codes for vectors of dim components."""
    return (4, 64) if dim >= 32 else (2, 256) if dim >= 12 else (1, 1024) if dim >= 3 else (1, 64)


@lru_cache(16)
def code(dim: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, codewords by block) of one code for vectors of dim components, padded to a multiple of the blocks."""
    rng = np.random.default_rng((_SEED, dim, which))
    blocks, codewords = shape(dim)
    size = -(-dim // blocks)
    rotation = np.linalg.qr(rng.standard_normal((size * blocks, size * blocks)))[0]
    words = rng.standard_normal((blocks, codewords, size))
    return rotation, words / np.linalg.norm(words, axis=2, keepdims=True)


def margin(dim: int) -> float:
    """How far below its best direction a vector's threshold lies."""
    return DEVIATIONS * math.sqrt(shape(dim)[0] / dim)


def _halves(x: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Inner products with all combinations of codewords of the first half of the blocks, and of the second."""
    size = words.shape[2]
    part = [x[:, i * size : (i + 1) * size] @ words[i].T for i in range(len(words))]
    if len(part) < 4:
        return part if len(part) == 2 else [part[0], np.zeros((len(x), 1))]
    return [(part[i][:, :, None] + part[i + 1][:, None, :]).reshape(len(x), -1) for i in (0, 2)]


def decode(unit: np.ndarray) -> list[np.ndarray]:
    """The filters of each unit vector, ascending: all directions whose inner product exceeds its threshold, in every code."""
    out: list[list[np.ndarray]] = [[] for _ in unit]
    most = 64
    for which in range(CODES):
        rotation, words = code(unit.shape[1], which)
        padded = np.zeros((len(unit), len(rotation)))
        padded[:, : unit.shape[1]] = unit
        left, right = _halves(padded @ rotation, words)
        width, base = right.shape[1], which * left.shape[1] * right.shape[1]
        wanted = left.max(axis=1) + right.max(axis=1) - margin(unit.shape[1])
        # A half can't be further below its best than the sum may be.
        near = [h >= (wanted - g.max(axis=1))[:, None] for h, g in ((left, right), (right, left))]
        wide = np.maximum(near[0].sum(axis=1), near[1].sum(axis=1)) > most
        few = np.flatnonzero(~wide)
        if len(few):
            best = [np.argpartition(-h[few], min(most, h.shape[1]) - 1, axis=1)[:, :most] for h in (left, right)]
            x, y = (np.take_along_axis(h[few], i, 1) for h, i in zip((left, right), best))
            v, i, j = np.nonzero(x[:, :, None] + y[:, None, :] >= wanted[few, None, None])
            filters = base + best[0][v, i] * width + best[1][v, j]
            for k, part in zip(few, np.split(filters, np.cumsum(np.bincount(v, minlength=len(few)))[:-1])):
                out[k].append(part)
        for k in np.flatnonzero(wide):
            a, b = np.flatnonzero(near[0][k]), np.flatnonzero(near[1][k])
            i, j = np.nonzero(left[k, a][:, None] + right[k, b] >= wanted[k])
            out[k].append(base + a[i] * width + b[j])
    return [np.sort(np.concatenate(x)).astype(np.int32) for x in out]


def units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the vectors can be linked; those at unit length in double precision, end to end; where each begins."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten()
    holds_null = np.zeros(len(lists), dtype=bool)
    owner = np.repeat(np.arange(len(lists)), lengths)
    if values.null_count:
        holds_null[owner[values.is_null().to_numpy(zero_copy_only=False)]] = True
        values = values.fill_null(0)
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    top = np.zeros(len(lists))
    np.maximum.at(top, owner, np.where(np.isfinite(x), np.abs(x), np.inf))
    good = ~holds_null & (top > 0) & np.isfinite(top)
    x, owner = x[good[owner]] / top[owner[good[owner]]], owner[good[owner]]
    norm = np.sqrt(np.bincount(owner, weights=x * x, minlength=len(lists)))
    at = np.zeros(int(good.sum()) + 1, dtype=np.int64)
    np.cumsum(lengths[good], out=at[1:])
    return np.flatnonzero(good), x / norm[owner], at


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, copies, embedding) in; rep, copies, embedding and filters of the vectors that can be linked out."""
    for whole in batches:
        for first in range(0, whole.num_rows, 1024):
            batch = whole.slice(first, 1024)
            good, x, at = units(batch.column(2))
            filters: list[np.ndarray] = [np.zeros(0, np.int32)] * len(good)
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                for k in range(0, len(which), 128):
                    part = which[k : k + 128]
                    for i, f in zip(part, decode(np.array([x[at[i] : at[i + 1]] for i in part]))):
                        filters[i] = f
            ends = np.concatenate([[0], np.cumsum([len(f) for f in filters])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(filters) if filters else np.zeros(0, np.int32)))
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in range(3)), lists], names=["rep", "copies", "embedding", "filters"])


def _earlier(filters: list[np.ndarray], key: int, a: int, b: int) -> bool:
    """Whether two members share a filter that is smaller than the key: then they are counted there."""
    x, y = (filters[k][: np.searchsorted(filters[k], key)] for k in (a, b))
    return len(np.intersect1d(x, y, assume_unique=True)) > 0


def _linked_pairs(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of vectors have the cosine, by products of the last two axes; the diagonal is left out."""
    product = unit @ np.swapaxes(unit, -1, -2)
    linked = product >= cosine
    for at in np.argwhere(np.abs(product - cosine) < DOUBT).tolist():
        x, y = unit[(*at[:-2], at[-2])], unit[(*at[:-2], at[-1])]
        linked[tuple(at)] = math.sumprod(x, y) >= cosine
    diagonal = np.arange(unit.shape[-2])
    linked[..., diagonal, diagonal] = False
    return linked


def tile_links(key: int, tile: np.ndarray, unit: np.ndarray, filters: list[np.ndarray], across: bool, cosine: float, linked: np.ndarray | None = None) -> np.ndarray:
    """The matrix of pairs of a bucket's tile, or across two tiles, that are linked and share no smaller filter; all of one length."""
    linked = _linked_pairs(unit, cosine) if linked is None else linked
    if across:
        linked &= tile[:, None] != tile
    if not linked.any():
        return linked
    if len(unit) <= 8:
        for a, b in np.argwhere(np.triu(linked)).tolist():
            linked[a, b] = linked[b, a] = not _earlier(filters, key, a, b)
        return linked
    smaller = [f[: np.searchsorted(f, key)] for f in filters]
    owner = np.repeat(np.arange(len(smaller)), [len(f) for f in smaller])
    _, column, times = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    if shared.any():
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        for first in range(0, int(column.max()) + 1, 4096):
            now = (column >= first) & (column < first + 4096)
            has = np.zeros((len(unit), 4096), dtype=np.float32)
            has[owner[now], column[now] - first] = 1
            linked &= has @ has.T == 0
    return linked


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all members which links reach from one another."""
    out, fresh = [], np.ones(len(linked), dtype=bool)
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        queue = [i] if fresh[i] else []
        fresh[i] = False
        while queue:
            j = queue.pop()
            new = np.flatnonzero(linked[j] & fresh).tolist()
            fresh[new] = False
            out += [(j, k) for k in new]
            queue += new
    return out


@dataclass
class _Rows:
    """Rows of (key, i, j)-groups as arrays."""

    tile: np.ndarray
    rep: np.ndarray
    copies: np.ndarray
    unit: np.ndarray  # end to end
    at: np.ndarray
    filters: list[np.ndarray]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        _, unit, at = units(batch.column("embedding"))
        lists = batch.column("filters")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        return cls(*(batch.column(c).to_numpy() for c in ("tile", "rep", "copies")), unit, at, [flat[a:b] for a, b in zip(ends[:-1], ends[1:])])

    def part(self, a: int, b: int) -> _Rows:
        return _Rows(self.tile[a:b], self.rep[a:b], self.copies[a:b], self.unit[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a], self.filters[a:b])

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        if len(parts) == 1:
            return parts[0]
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.at) for p in parts]))])
        return _Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("tile", "rep", "copies", "unit")), at, [f for p in parts for f in p.filters])


#: Groups of up to so many rows are multiplied all at once, by size.
SMALL = 32


def _group_links(rows: _Rows, key: int, across: bool, cosine: float, known: np.ndarray | None = None) -> Iterator[tuple]:
    """(a, null, n) counts and (a, b, null) links of a group; known: which pairs have the cosine."""
    dims = np.diff(rows.at)
    for dim in np.unique(dims).tolist():
        which = np.flatnonzero(dims == dim)
        if len(which) > 1:
            unit = np.array([rows.unit[rows.at[i] : rows.at[i + 1]] for i in which])
            linked = tile_links(key, rows.tile[which], unit, [rows.filters[i] for i in which], across, cosine, known)
            counts = linked @ rows.copies[which]
            for k in np.flatnonzero(counts).tolist():
                yield int(rows.rep[which[k]]), None, int(counts[k])
            for j, k in _forest(linked):
                yield int(rows.rep[which[j]]), int(rows.rep[which[k]]), None


def _linked(cosine: float):
    """Rows (key, i, j, tile, rep, copies, embedding, filters) sorted by (key, i, j) in; (a, b, null) links and (a, null, n) counts out."""

    def whole_groups(rows: _Rows, keys: np.ndarray, cuts: np.ndarray) -> Iterator[tuple]:
        sizes, dims = np.diff(cuts), np.diff(rows.at)
        done = np.zeros(len(sizes), dtype=bool)
        if len(dims) and (dims == dims[0]).all():
            unit = rows.unit.reshape(len(dims), -1)
            for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
                which = np.flatnonzero(sizes == size)
                done[which] = True
                for k in range(0, len(which), 2048):
                    part = which[k : k + 2048]
                    linked = _linked_pairs(unit[cuts[part][:, None] + np.arange(size)], cosine)
                    for g in np.flatnonzero(linked.any(axis=(1, 2))).tolist():
                        a = int(cuts[part[g]])
                        yield from _group_links(rows.part(a, a + size), int(keys[a, 0]), keys[a, 1] != keys[a, 2], cosine, linked[g])
        for g in np.flatnonzero(~done & (sizes > 1)).tolist():
            a, b = int(cuts[g]), int(cuts[g + 1])
            yield from _group_links(rows.part(a, b), int(keys[a, 0]), keys[a, 1] != keys[a, 2], cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Rows] = []  # of a group that may go on in the next batch
        now = None

        def out(found: Iterator[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

        def close() -> Iterator[tuple]:
            rows = _Rows.joined(held) if held else None
            held.clear()
            if rows is not None and len(rows.rep) > 1:
                yield from _group_links(rows, now[0], now[1] != now[2], cosine)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows.of(batch)
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            first, last = tuple(keys[0].tolist()), tuple(keys[-1].tolist())
            if first == now:
                held.append(rows.part(0, int(cuts[1])))
                cuts = cuts[1:]
                if len(cuts) == 1:
                    continue  # all of the batch is of the group
            yield out(close())
            yield out(whole_groups(rows, keys, cuts[:-1]))
            held.append(rows.part(int(cuts[-2]), int(cuts[-1])))
            now = last
        yield out(close())

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding).

    A vector that is null, empty or zero, or holds a null or non-finite component, links with
    nothing; neither do vectors of different lengths. Equal vectors are linked by
    definition and handled as one; they are told by 128 bits of hash. A row without vec_id gets null component and
    kept. Rows that share a vec_id count as vectors of their own in n_links and are
    one node. Other columns (labels too) are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    plain = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("embedding"))
    # A null component hashes like one that isn't there, so it is marked.
    marked = (F.col("embedding"), F.transform("embedding", lambda c: c.isNull()))
    known = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    rows = rows.select("vec_id", "embedding", F.when(known, F.xxhash64(*marked)).alias("h1"), F.when(known, F.xxhash64(F.lit("vector"), *marked)).alias("h2"))
    reps = rows.where(known).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = store.saved(reps, "reps")
    kind = reps.schema["embedding"].dataType.simpleString()
    filtered = store.saved(
        reps.select("rep", "copies", "embedding").mapInArrow(_filtered, f"rep long, copies long, embedding {kind}, filters array<int>"), "filtered"
    )
    member = filtered.select("rep", F.explode("filters").alias("key"))
    tiles = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    tiled = member.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = store.saved(tiled.select("rep", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile"), "tiles")
    dealt = (
        pairs.join(filtered, "rep")
        .select("key", "i", "j", "tile", "rep", "copies", "embedding", "filters")
        .repartition(store.partitions_of(spark), "key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    found = store.saved(dealt.mapInArrow(_linked(cosine), "a long, b long, n long"), "found")
    store.drop(pairs, filtered)
    of = components(found.where("b IS NOT NULL"))
    counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    named = (
        reps.select("h1", "h2", "rep", "copies")
        .join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(of.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", "copies", "n", F.coalesce("component", "rep").alias("component"))
    )
    # Copies of a vector that links with nothing, such as a zero vector, aren't linked either.
    able = F.exists("embedding", lambda c: c != 0) & F.forall("embedding", lambda c: F.coalesce(c.between(-MOST, MOST), F.lit(False)))
    return (
        rows.select("vec_id", "h1", "h2", F.coalesce(able, F.lit(False)).alias("able"))
        .join(named, ["h1", "h2"], "left")
        .select(
            "vec_id",
            F.when(F.col("vec_id").isNotNull() & F.col("able"), F.col("copies") - 1 + F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(F.col("able"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
