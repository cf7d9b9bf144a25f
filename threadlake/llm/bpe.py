"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

Each word's symbols are the leaves' left ends: leaf i holds the rank of the pair
(symbol i, next living symbol), with i itself in the low bits, or "none". The
root's minimum is then the leftmost pair of lowest rank. A merge replaces the
left symbol, drops the right one and changes three leaves at most, each with one
walk to the root. All words of a length class are worked on in step: a round
takes one merge from every tree that still has one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlake.llm import store
from threadlake.llm import words as W

_NONE = np.int64(1 << 62)
#: At most so many leaves in the trees of one step.
_LEAVES = 1 << 17
#: So many words' ids are kept at most: each of an executor's workers has them.
_WORDS = 50_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


class MergeTable:
    """Vocabulary and merge ranks of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for name, i in [*vocab.items(), *self.specials.items()]:
            self.names[i] = name
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int64)
        made: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        order = sorted(made)
        self._keys = np.array(order, dtype=np.int64)
        self._ranks = np.array([made[k][0] for k in order], dtype=np.int64)
        self._made = np.array([made[k][1] for k in order], dtype=np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pair stands in the table, or -1."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[i] == key, i, -1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        i = self.find(left, right)
        return np.where(i >= 0, self._ranks[i], _NONE)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by length class."""
        raw = [w.encode("utf-8") for w in words]
        out: list[list[int]] = [[] for _ in words]
        classes: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) == 1:
                out[i] = [int(self.last[b[0]])]
            elif b:
                classes.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            step = max(1, _LEAVES // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge([raw[i] for i in part], size)):
                    out[i] = ids
        return out

    def _merge(self, raw: list[bytes], size: int) -> list[list[int]]:
        n, lengths = len(raw), np.array([len(b) for b in raw], dtype=np.int64)
        column = np.arange(size, dtype=np.int64)
        flat = np.frombuffer(b"".join(b.ljust(size, b"\0") for b in raw), dtype=np.uint8).reshape(n, size)
        token = np.where(column == lengths[:, None] - 1, self.last[flat], self.inner[flat])
        alive = column < lengths[:, None]
        after = np.where(column + 1 < lengths[:, None], column + 1, size)
        before = np.broadcast_to(column - 1, (n, size)).copy()
        # A tree's node k has the children 2k and 2k + 1; the leaves are size .. 2 size - 1.
        tree = np.full((n, 2 * size), _NONE, dtype=np.int64)
        first = np.full((n, size), _NONE, dtype=np.int64)
        first[:, :-1] = self.ranks(token[:, :-1], token[:, 1:])
        first[column >= lengths[:, None] - 1] = _NONE
        tree[:, size:] = np.where(first < _NONE, first * size + column, _NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(rows: np.ndarray, leaves: np.ndarray, values: np.ndarray) -> None:
            node = leaves + size
            tree[rows, node] = values
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while True:
            rows = np.flatnonzero(tree[:, 1] < _NONE)
            if not len(rows):
                break
            i = tree[rows, 1] % size
            j = after[rows, i]
            made = self._made[self.find(token[rows, i], token[rows, j])]
            token[rows, i] = made
            alive[rows, j] = False
            k = after[rows, j]
            after[rows, i] = k
            has = k < size
            before[rows[has], k[has]] = i[has]
            put(rows, j, np.full(len(rows), _NONE))
            right = np.full(len(rows), _NONE)
            right[has] = self.ranks(made[has], token[rows[has], k[has]])
            put(rows, i, np.where(right < _NONE, right * size + i, _NONE))
            h = before[rows, i]
            has = h >= 0
            if has.any():
                r, h = rows[has], h[has]
                left = self.ranks(token[r, h], made[has])
                put(r, h, np.where(left < _NONE, left * size + h, _NONE))
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        flat = token[alive].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each Python worker, so that later tasks find the words that earlier ones have met."""
    return Codec(path)


def normalised(text: str) -> str:
    """NFC, then lower case of each character by itself (white space never reaches a word)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class Codec:
    """Encodes and decodes whole texts; the ids of a word are kept while its table holds it."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self._clear()
        self._words = W.WordTable(self._learn, self._clear, _WORDS)

    def _clear(self) -> None:
        self._count: list[int] = []
        self._ids: list[bytes] = []
        self._names: list[bytes] = []

    def _learn(self, words: list[str]) -> None:
        names = self.table.names
        for ids in self.table.encode(words):
            self._count.append(len(ids))
            self._ids.append(" ".join(map(str, ids)).encode())
            self._names.append(" ".join([names[i] for i in ids]).encode())

    def _pieces(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids as decimal text, decoded text) of each text without special tokens."""
        texts = [normalised(t) for t in texts]
        for a, b in W.blocks(texts):
            whole, codes, at = W.code_points(texts[a:b])
            starts, ends = W.word_end_slices(codes, at)
            slots = self._words.slots(whole, codes, starts, ends)
            cuts = np.searchsorted(starts, at)
            counts = np.zeros(len(slots) + 1, dtype=np.int64)
            np.cumsum(np.array(self._count, dtype=np.int64)[slots], out=counts[1:])
            ids, names, slots = self._ids, self._names, slots.tolist()
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = slots[i:j]
                yield int(counts[j] - counts[i]), b" ".join([ids[s] for s in part]), b" ".join([names[s] for s in part])

    def process(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        specials = tuple(self.table.specials)
        whole = [t or "" for t in texts]
        odd = {i for i, t in enumerate(whole) if any(s in t for s in specials)}
        plain = self._pieces([t for i, t in enumerate(whole) if i not in odd])
        return [self._with_specials(t, specials) if i in odd else next(plain) for i, t in enumerate(whole)]

    def _with_specials(self, text: str, specials: tuple[str, ...]) -> tuple[int, bytes, bytes]:
        n, ids, names = 0, [], []
        for kind, piece in W.cut_at(text, specials):
            if kind == "special":
                got = (1, str(self.table.specials[piece]).encode(), piece.encode())
            else:
                got = next(self._pieces([piece]))
            if got[0]:
                n, ids, names = n + got[0], [*ids, got[1]], [*names, got[2]]
        return n, b" ".join(ids), b" ".join(names)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.process([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by a blank: the file names no decoder, so that is what its library returns."""
        return " ".join(self.table.names[i] for i in ids)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, ids (decimal, one blank between) and decoded text of every row, with digests of both.

    Null and empty texts have no tokens, and digests of the empty string; repeated
    rows each give a row; a null id stays null. Any other columns are left out. The
    tokenizer file must be at the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            rows = codec(path).process(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    store.small_batches(docs.sparkSession)
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
