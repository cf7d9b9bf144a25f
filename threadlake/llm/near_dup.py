"""MinHash near-duplicates with odd sketches.

A document's set of word shingles is hashed to 64 bits a shingle, and SAMPLES
MinHash values are taken of it. They serve twice: groups of ROWS of them are the
band keys that bring similar documents together, and all of them are folded into
an odd sketch, a bitmap whose bit holds the parity of the samples that fall on
it. Equal samples cancel out in the XOR of two sketches, so its population count
tells the similarity most precisely where it is high; pairs that are clearly too
far apart stop there, and the rest are confirmed on the full sets.

Groups of copies are never expanded into pairs:

* Texts with the same set are one representative.
* In each band's bucket, every member is tried with the bucket's smallest member.
  The links that hold give components.
* A bucket that then still holds several components may hide links between
  them. Its sketches are compared in tiles of TILE members at most, and a tile
  emits only a spanning forest of the components between which some pair is
  promising. The representatives of components so joined are gathered, in pairs of
  tiles again, and all intersections of full sets across components come from one
  product of the tile's membership matrix; only a spanning forest of the links
  leaves a task. After that, any two representatives of a bucket are in one
  component or have been tried, and no step made a row for each pair of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm import store
from threadlake.llm import words as W
from threadlake.llm.components import components

SHINGLE = 5
#: A pair at the least similarity, 0.75, shares none of the 32 bands with probability (1 - 0.75^4)^32, 6e-6.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Sketches that estimate less than this are too far apart; five deviations below the threshold.
SKETCH_FLOOR = 0.45
NUMERATOR, DENOMINATOR = 75, 100
#: Members of a tile; for full sets also so many shingles in all, about.
TILE, TILE_SETS, TILE_SHINGLES = 1024, 256, 500_000
#: At most so many rows of two ids are broadcast.
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(20240607)
_STEPS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def max_flips(floor: float = SKETCH_FLOOR) -> int:
    """The largest XOR population count whose estimate, 1 + n / 4k ln(1 - 2x / n), is at least floor."""
    return int(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - floor) / SKETCH_BITS)))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of texts: all shingles' hashes end to end, and where each text's begin (with the total at the end).

    Repeats are still in. A text of fewer than five words has one shingle, all its words.
    """
    raw = [(t or "").encode() for t in texts]
    for a, b in W.blocks(raw):
        data, at = W.byte_words(raw[a:b])
        gap = _BLANK[data]
        begins = ~gap
        begins[1:] &= gap[:-1]
        starts = np.flatnonzero(begins)
        stop = gap.copy()
        stop[0] = False
        stop[1:] &= ~gap[:-1]
        ends = np.flatnonzero(stop)
        h = W.slice_hashes(data, starts, ends)
        first = np.searchsorted(starts, at)
        words = np.diff(first)
        size = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
        begin = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=begin[1:])
        # The word that each shingle starts with, and how many words it has.
        lead = np.repeat(first[:-1] - begin[:-1], size) + np.arange(begin[-1])
        width = np.repeat(np.minimum(words, SHINGLE), size)
        padded = np.concatenate([h, np.zeros(SHINGLE, dtype=np.uint64)])
        total = width.astype(np.uint64)
        short = width < SHINGLE
        for k in range(SHINGLE):
            part = padded[lead + k] * _STEPS[k]
            part[short & (width <= k)] = 0
            total = total + part
        yield W.mixed(total), begin


def _signatures(texts: list[str | None]) -> Iterator[tuple]:
    """(n_shingles, fingerprint high, low, band keys, sketch) columns for blocks of texts."""
    for h, begin in shingle_sets(texts):
        n_docs = len(begin) - 1
        n = np.zeros(n_docs, dtype=np.int64)
        prints = np.zeros((n_docs, 2), dtype=np.uint64)
        other = W.mixed(h + _SALT[0])
        for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            if b - a > 1:
                part, index = np.unique(h[a:b], return_index=True)
                n[i], prints[i] = len(part), (part.sum(), other[a:b][index].sum())
            elif b > a:
                n[i], prints[i] = 1, (h[a], other[a])
        bands = np.zeros((n_docs, BANDS), dtype=np.int64)
        sketch = np.zeros((n_docs, SKETCH_BITS // 64), dtype=np.int64)
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            least = np.empty((SAMPLES, len(some)), dtype=np.uint64)
            for k in range(SAMPLES):
                np.minimum.reduceat(h * _PERMUTE[k], begin[some], out=least[k])
            keyed = W.mixed(least + _SALT[:, None])
            bit = (keyed >> np.uint64(7)) % np.uint64(SKETCH_BITS)
            tally = np.bincount((np.arange(len(some)) * SKETCH_BITS + bit.astype(np.int64)).ravel(), minlength=len(some) * SKETCH_BITS)
            sketch[some] = np.packbits((tally & 1).astype(np.uint8).reshape(len(some), -1), axis=1).view(np.int64)
            groups = keyed.reshape(BANDS, ROWS, len(some))
            total = (np.arange(1, BANDS + 1, dtype=np.uint64) * _SALT[:BANDS])[:, None] + np.zeros(len(some), dtype=np.uint64)
            for r in range(ROWS):
                total = total + groups[:, r] * _PERMUTE[r]
            bands[some] = W.mixed(total).view(np.int64).T
        yield n, prints.view(np.int64), bands, sketch


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            parts = list(zip(*_signatures(batch.column(1).to_pylist())))
            if not parts:
                continue
            n, prints, bands, sketch = map(np.concatenate, parts)
            lists = [
                pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel())) for x in (bands, sketch)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), *lists], names=["doc_id", "n", "f1", "f2", "bands", "sketch"]
            )

    store.small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def _near(left: str, right: str) -> Column:
    """The cheap tests: set sizes that allow the similarity, and sketches that don't rule it out."""
    n1, n2 = F.col(f"{left}.n"), F.col(f"{right}.n")
    sizes = F.least(n1, n2) * DENOMINATOR >= F.greatest(n1, n2) * NUMERATOR
    flips = sum((F.bit_count(F.get(f"{left}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{right}.sketch", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return sizes & (flips <= max_flips())


def _bounded(df: DataFrame) -> DataFrame:
    """df is a saved table of ids; it is broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def confirmed(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, saved."""
    ids = store.saved(edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(_bounded(ids), "doc_id")
    paired = (
        edges.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            step = 256
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = part.column(2).to_pylist() + part.column(3).to_pylist()
                sets = [np.unique(h[i:j]) for h, begin in shingle_sets(texts) for i, j in zip(begin[:-1].tolist(), begin[1:].tolist())]
                for x, y in zip(sets[: part.num_rows], sets[part.num_rows :]):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return store.saved(paired.mapInArrow(run, "a long, b long").distinct(), "links")


def _tile_pairs(members: DataFrame, key: str, texts: DataFrame | None = None) -> DataFrame:
    """Each member of a group once for every pair of tiles that its own is in, dealt and sorted by (group, i, j)."""
    tiled = members.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    paired = tiled.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other").withColumnRenamed(key, "group")
    if texts is not None:
        paired = paired.join(texts, "rep")
    first = ["group", "i", "j", "tile", "rep", "c"]
    rest = [c for c in paired.columns if c not in first]
    return paired.select(*first, *rest).repartition(store.partitions_of(members.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """(whether two tiles meet, tile, rep, c, the group's rows) of each (group, i, j); a group has two tiles at most."""
    held: list[pa.RecordBatch] = []
    now = None

    def whole() -> tuple:
        table = pa.Table.from_batches(held)
        tile, rep, c = (table.column(k).to_numpy() for k in (3, 4, 5))
        return now[1] != now[2], tile, rep, c, table

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and tuple(keys[a]) != now:
                yield whole()
                held = []
            now = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _forest(near: np.ndarray, names: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of names that join the labels which near pairs connect; each takes two labels that weren't yet joined."""
    at = {x: i for i, x in enumerate(dict.fromkeys(labels.tolist()))}
    parent = list(range(len(at)))
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    left = len(at) - 1
    for p in np.flatnonzero(near.any(axis=1)).tolist():
        if not left:
            break
        for q in np.flatnonzero(near[p]).tolist():
            x, y = root(at[labels[p]]), root(at[labels[q]])
            if x != y:
                parent[x] = y
                left -= 1
                out.append((int(names[p]), int(names[q])))
    return out


def _across(meet: bool, tile: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The pairs that a task tries: of different components, and of different tiles where two meet."""
    wanted = c[:, None] < c[None, :]
    return wanted & (tile[:, None] != tile[None, :]) if meet else wanted


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _promising_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for meet, tile, _, c, table in _groups(batches):
        wanted = _across(meet, tile, c)
        if wanted.any():
            n = table.column("n").to_numpy().astype(np.float64)
            words = np.array(table.column("sketch").to_pylist(), dtype=np.int64)
            signs = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1).astype(np.float32) * 2 - 1
            flips = (SKETCH_BITS - signs @ signs.T) / 2
            near = wanted & (flips <= max_flips()) & (np.minimum(n[:, None], n) * DENOMINATOR >= np.maximum(n[:, None], n) * NUMERATOR)
            yield _edges(_forest(near, c, c))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections of sets of hashes, by products of slices of their membership matrix."""
    sizes = [len(x) for x in sets]
    out = np.diag(np.array(sizes, dtype=np.float64))
    owner = np.repeat(np.arange(len(sets)), sizes)
    column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    step = 4096
    for first in range(0, int(column[-1]) + 1, step):
        a, b = np.searchsorted(column, [first, first + step])
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        total += part @ part.T
    np.fill_diagonal(total, sizes)
    return total


def _cross_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for meet, tile, rep, c, table in _groups(batches):
        wanted = _across(meet, tile, c)
        if wanted.any():
            sets = [np.unique(h[i:j]) for h, begin in shingle_sets(table.column("text").to_pylist()) for i, j in zip(begin[:-1].tolist(), begin[1:].tolist())]
            size = np.array([len(x) for x in sets], dtype=np.float64)
            common = intersections(sets)
            linked = wanted & (DENOMINATOR * common >= NUMERATOR * (size[:, None] + size - common))
            yield _edges(_forest(linked, rep, c))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Null, empty and wordless texts have no shingles and are linked with nothing. A
    row without a doc_id can't be named: its component is null and it isn't kept
    or dropped for another (kept is null). Rows that share a doc_id are one node. Other
    columns are left out; an empty table gives no rows.
    """
    signed = store.saved(signatures(docs), "signed")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    reps = (
        full.groupBy("f1", "f2", "n")
        .agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("s"))
        .select("f1", "f2", "n", F.col("s.doc_id").alias("rep"), "s.bands", "s.sketch")
    )
    reps = store.saved(reps, "reps")
    sketches = reps.select("rep", "n", "sketch")

    members = reps.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = store.saved(members.join(buckets, "key"), "shared")  # only members of buckets with several

    def promising(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketches.select(F.col("rep").alias("b"), F.struct("n", "sketch").alias("y")), "b").join(
            sketches.select(F.col("rep").alias("a"), F.struct("n", "sketch").alias("x")), "a"
        )
        return near.where(_near("x", "y")).select("a", "b")

    stars = shared.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    tried = store.saved(promising(stars), "stars")
    links = confirmed(tried, docs)
    of = components(links)

    placed = shared.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("size")).where("least <> most")
    tiles = mixed.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    open_ = store.saved(placed.join(tiles, "key").join(sketches, "rep").select("key", "tiles", "rep", "c", "n", "sketch"), "open")
    joined = store.saved(_tile_pairs(open_, "key").mapInArrow(_promising_components, "a long, b long"), "promising")
    clusters = store.saved(components(joined).select(F.col("node").alias("c"), F.col("component").alias("cluster")), "clusters")
    if clusters.take(1):
        everyone = reps.select("rep", "n").join(of.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("c"))
        gathered = store.saved(everyone.join(clusters, "c"), "gathered")
        share = F.greatest(F.count("*") / TILE_SETS, F.sum("n") / TILE_SHINGLES)
        sized = gathered.join(gathered.groupBy("cluster").agg(F.ceil(share).cast("int").alias("tiles")), "cluster")
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(_bounded(gathered.select("rep")), "rep")
        more = _tile_pairs(sized.select("cluster", "tiles", "rep", "c"), "cluster", texts).mapInArrow(_cross_links, "a long, b long")
        of = components(links.unionByName(store.saved(more, "crossing")))

    named = reps.select("f1", "f2", "n", "rep").join(of.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("doc_id", "f1", "f2", "n")
        .join(named, ["f1", "f2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, the one of smallest doc_id; every column stays, and so do rows without an id."""
    gone = store.saved(near_duplicates(docs).where("kept = false").select("doc_id").distinct(), "gone")
    return docs.join(_bounded(gone), "doc_id", "left_anti").select(docs.columns)
