"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a short vector of counts and shares, log-transformed. The
two classes get a mean and a covariance each, over a bounded sample of labelled
rows; a covariance is shrunk towards the pooled one and towards its own diagonal,
and its Cholesky factor is kept. A score is the logistic of the difference of the
classes' Gaussian log-densities (Mahalanobis distance through the factor, plus
log-determinant) and of their shares, so 1 means: label 1 is likelier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm import store
from threadlake.llm import words as W

#: The classifier is fitted on at most so many labelled rows, those of least hash of doc_id.
FIT_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
#: Weights of the pooled covariance and of the own diagonal.
POOLED, DIAGONAL = 0.1, 0.05

_CLASS = np.zeros(256, dtype=np.uint8)
_NAMES = ("other", "lower", "upper", "digit", "blank", "line", "stop", "mark", "bar", "shout", "high")
for _name, _chars in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", (32, 9)), ("line", (10, 13)),
    ("stop", b".,;:"), ("mark", b"#$%&*@^~=+_<>{}[]\\"), ("bar", b"|"), ("shout", b"!?"), ("high", range(128, 256)),
):
    _CLASS[list(_chars)] = _NAMES.index(_name)
N_FEATURES = 19
#: Shares that are usual in prose. Every text is counted as if so many characters and words of such prose stood beside it, so that a text of a few words is judged by little.
USUAL = {"upper": 0.02, "digit": 0.003, "stop": 0.02, "mark": 0.002, "bar": 0.002, "shout": 0.002, "high": 0.02, "other": 0.003, "lower": 0.78, "short": 0.4, "wide": 0.1, "repeated": 0.3, "lines": 0.05}
USUAL_CHARS, USUAL_WORDS = 500.0, 100.0


def features(texts: list[str | None]) -> np.ndarray:
    """One vector for each text; an empty or null text has the vector of counts 0."""
    raw = [(t or "").encode() for t in texts]
    out = [np.zeros((0, N_FEATURES))]
    for a, b in W.blocks(raw):
        part = raw[a:b]
        at = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in part], out=at[1:])
        data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)  # a line feed ends each text
        n_docs, kind = len(part), _CLASS[data]
        doc = np.repeat(np.arange(n_docs), np.diff(at))
        tally = np.bincount(doc * 16 + kind, minlength=16 * n_docs).reshape(n_docs, 16)[:, : len(_NAMES)].astype(float)
        tally[:, _NAMES.index("line")] -= 1
        size = np.diff(at) - 1.0
        gap = (kind == _NAMES.index("blank")) | (kind == _NAMES.index("line"))
        begins = ~gap
        begins[1:] &= gap[:-1]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        long = ends - starts
        owner = doc[starts]
        words = np.bincount(owner, minlength=n_docs).astype(float)
        short = np.bincount(owner[long <= 3], minlength=n_docs)
        wide = np.bincount(owner[long >= 12], minlength=n_docs)
        squares = np.bincount(owner, weights=long.astype(float) ** 2, minlength=n_docs)
        letters = np.bincount(owner, weights=long.astype(float), minlength=n_docs)
        h = W.slice_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        distinct = _distinct(owner, h, n_docs)
        line_ends = np.flatnonzero(data == 10)
        line_starts = np.concatenate([[0], line_ends[:-1] + 1]) if len(line_ends) else line_ends
        full = line_ends > line_starts
        line_owner = doc[line_starts[full]] if full.any() else np.zeros(0, np.int64)
        lines = np.bincount(line_owner, minlength=n_docs).astype(float)
        line_distinct = _distinct(line_owner, W.slice_hashes(data, line_starts[full], line_ends[full]), n_docs)
        share = lambda x, of, usual, weight: np.log((x + weight * usual) / (of + weight))
        of_chars = lambda kind: share(tally[:, _NAMES.index(kind)], size, USUAL[kind], USUAL_CHARS)
        of_words = lambda x, kind: share(x, words, USUAL[kind], USUAL_WORDS)
        mean = letters / np.maximum(words, 1)
        out.append(
            np.column_stack(
                [
                    np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(np.maximum(squares / np.maximum(words, 1) - mean**2, 0)),
                    *(of_chars(k) for k in ("upper", "digit", "stop", "mark", "bar", "shout", "high", "other")),
                    of_words(short, "short"), of_words(wide, "wide"), of_words(words - distinct, "repeated"), np.log1p(lines),
                    of_words(lines, "lines"), np.log((lines - line_distinct + 0.1) / (lines + 1.0)), of_chars("lower"),
                ]
            )
        )
    return np.concatenate(out)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each owner; owners are in ascending order."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, owner))
    o, h = owner[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[first], minlength=n).astype(float)


@dataclass(frozen=True)
class Discriminant:
    """Class shares, means and inverse Cholesky factors; a missing class makes every score the share of label 1."""

    share: float
    means: np.ndarray | None
    factors: np.ndarray | None
    logdets: np.ndarray | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        density = []
        for mean, inverse, logdet in zip(self.means, self.factors, self.logdets):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * logdet)
        gap = density[1] - density[0] + np.log(self.share) - np.log1p(-self.share)
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Every fifth document, by crc32 of its id as text; a null id is held out of fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant:
    """From each class's number of rows, sum and sum of outer products."""
    total = sum(n for n, _, _ in moments.values())
    if any(moments[k][0] < 2 for k in (0, 1)):
        return Discriminant((moments[1][0] / total) if total else 0.5, None, None, None)
    means, spreads = [], []
    for k in (0, 1):
        n, s, ss = moments[k]
        means.append(s / n)
        spreads.append(ss / n - np.outer(s / n, s / n))
    pooled = sum(moments[k][0] * spreads[k] for k in (0, 1)) / total
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    inverses, logdets = [], []
    for s in spreads:
        shrunk = (1 - POOLED - DIAGONAL) * s + POOLED * pooled + DIAGONAL * (np.diag(np.diag(s)) + 0.1 * scale)
        low = np.linalg.cholesky(shrunk + 1e-4 * scale)
        inverses.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(moments[1][0] / total, np.array(means), np.array(inverses), np.array(logdets))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Discriminant:
    """Learns from labelled documents that aren't held out; only doc_id, text and quality are read.

    Labels that are null or neither 0 nor 1 are left out; a label that stands twice, or a document
    that does, counts twice. Other columns of any name may stand beside. Moments are summed where
    the texts are; one small row per task goes to the driver. From an empty table every score is a half.
    """
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))] for k in (0, 1)}
        for batch in W.slices(batches):
            x, y = features(batch.column(1).to_pylist()), np.array(batch.column(0).to_pylist())
            for k, s in sums.items():
                part = x[y == k]
                s[0] += len(part)
                s[1] += part.sum(axis=0)
                s[2] += part.T @ part
        for k, (n, s, ss) in sums.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([json.dumps([s.tolist(), ss.tolist()])])], names=["k", "n", "sums"])

    moments = {k: (0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))) for k in (0, 1)}
    for r in joined.mapInArrow(run, "k int, n long, sums string").collect():
        n, s, ss = moments[r["k"]]
        s1, ss1 = map(np.array, json.loads(r["sums"]))
        moments[r["k"]] = (n + r["n"], s + s1, ss + ss1)
    return discriminant(moments)


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts are scored like any other.

    Repeated rows each give a row; other columns are left out. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            s = model.scores(features(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(s >= threshold).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    store.small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns.

    Null and empty texts are scored like any other, repeated rows alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            yield batch.filter(pa.array(model.scores(features(batch.column("text").to_pylist())) >= threshold))

    store.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
