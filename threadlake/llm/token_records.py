"""Token ids as length-delimited binary records.

A file is a run of frames, in ascending order of document id:

    8 bytes  length of the payload, unsigned, little-endian
    4 bytes  masked checksum of those 8 bytes
    payload  document id (8 bytes, signed), how many bytes an id takes (1 byte: 2 where
             the vocabulary has at most 65,536 ids, else 4), then the ids; little-endian
    4 bytes  masked checksum of the payload
    1 byte   a line feed, which Spark's writer puts after every row

The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a
checksum stored among data isn't itself checked as data. An offset index beside
the files holds (file, row, doc_id, offset, length) for every frame: a reader
that shuffles picks rows of the index (fetch). The number of files follows the
bytes of text, so that a file is about FILE_BYTES of text. Spark's own text writer writes
the frames, so commits are atomic on any file system and a lost executor's work
is simply done again; the driver never holds ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import store
from threadlake.llm import words as W

#: Fixed value: the constant that record formats with masked checksums add.
MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
END_ID = 0
#: Text that goes into a file, about; its ids take half of that or so.
FILE_BYTES = 64 << 20


def masked_crc(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without the line feed that ends its row."""
    n = len(payload).to_bytes(8, "little")
    return n + _TAIL.pack(masked_crc(n)) + payload + _TAIL.pack(masked_crc(payload))


def ids_of(payload: memoryview) -> np.ndarray:
    """The ids of a payload, by the width that it names."""
    if payload[8] not in (2, 4):
        raise ValueError(f"ids can't take {payload[8]} bytes")
    return np.frombuffer(payload[9:], dtype=f"<u{payload[8]}")


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length with the line feed, payload) of each frame of a file; a damaged file raises ValueError."""
    view, at = memoryview(data), 0
    while at < len(view):
        if at + _HEAD.size > len(view):
            raise ValueError(f"the frame at byte {at} is cut off")
        n, crc = _HEAD.unpack_from(view, at)
        if masked_crc(view[at : at + 8]) != crc:
            raise ValueError(f"the length at byte {at} fails its checksum")
        body = view[at + 12 : at + 12 + n]
        if len(body) < n or at + 17 + n > len(view):
            raise ValueError(f"the frame at byte {at} is cut off")
        if masked_crc(body) != _TAIL.unpack_from(view, at + 12 + n)[0]:
            raise ValueError(f"the payload at byte {at + 12} fails its checksum")
        yield at, n + 17, body
        at += n + 17


class Encoder:
    """The tokenizers library's ids of whole texts; its model is asked once for each distinct piece while the table holds it.

    The file's byte-level pre-tokenizer cuts a text into pieces that are encoded
    each by itself, so a text's ids are its pieces' ids end to end. That cutting is
    done here, for a whole batch at once, not by the library; the tests compare the
    ids with those of the library's encode. A text with a special token goes to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._clear()
        self._words = W.WordTable(self._learn, self._clear)

    def _clear(self) -> None:
        self._pool = np.zeros(1 << 16, dtype=self.dtype)
        self._ends = np.zeros(1 << 14, dtype=np.int64)
        self._known = 0

    def _learn(self, words: list[str]) -> None:
        model = self.tokenizer.model
        shown = _shown()
        # A piece is within one pre-token, so the model itself may be asked, on the bytes' stand-ins.
        got = [[t.id for t in model.tokenize(w if w.isascii() and w.isalnum() else "".join([shown[b] for b in w.encode()]))] for w in words]
        flat = np.fromiter((i for ids in got for i in ids), dtype=self.dtype)
        k = self._known
        base = int(self._ends[k - 1]) if k else 0
        while len(self._pool) < base + len(flat):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while len(self._ends) < k + len(words):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._pool[base : base + len(flat)] = flat
        self._ends[k : k + len(words)] = base + np.cumsum([len(ids) for ids in got])
        self._known = k + len(words)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; a null text counts as empty."""
        whole = [t or "" for t in texts]
        for a, b in W.blocks(whole):
            part = whole[a:b]
            odd = {i for i, t in enumerate(part) if any(s in t for s in self.specials)}
            text, codes, at = W.code_points(["" if i in odd else t for i, t in enumerate(part)])
            starts, ends = W.byte_level_slices(codes, at)
            slots = self._words.slots(text, codes, starts, ends)
            stop = self._ends[slots]
            begin = np.where(slots > 0, self._ends[slots - 1], 0)
            sizes = stop - begin
            total = np.zeros(len(slots) + 1, dtype=np.int64)
            np.cumsum(sizes, out=total[1:])
            ids = self._pool[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
            cuts = total[np.searchsorted(starts, at)].tolist()
            for i, t in enumerate(part):
                if i in odd:
                    yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=self.dtype)
                else:
                    yield ids[cuts[i] : cuts[i + 1]]


@lru_cache(1)
def _shown() -> list[str]:
    from threadlake.llm.bpe import byte_symbols

    return byte_symbols()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks find the pieces that earlier ones have met."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer_path: str, to: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encodes every whole text, ends each with end_id and writes <to>/data and <to>/index.

    docs has doc_id and text; other columns are left out. A null text counts as
    empty; a null doc_id raises, as a record needs one. Rows with equal doc_id stay
    side by side, ordered by a hash of their text, and may go on in the next file.
    An empty table gives an index without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.expr("coalesce(cast(doc_id as long), raise_error('a record needs a doc_id'))").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).collect()[0][0] or 0
        parts = max(store.partitions_of(spark), -(-size // FILE_BYTES), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), bytes([enc.dtype.itemsize])
        for batch in W.slices(batches):
            ids = zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()))
            made = [frame(i.to_bytes(8, "little", signed=True) + width + x.tobytes() + end) for i, x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["frame"])

    tie = F.xxhash64("text").alias("tie")
    ordered = rows.select("doc_id", "text", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(f"{to}/data")
    read(spark, to, index_only=True).write.parquet(f"{to}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, content; a file is one row, whose size FILE_BYTES bounds."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read(spark: SparkSession, path: str, index_only: bool = False) -> DataFrame:
    """Every record of the files: file, row, doc_id, offset, length, n_tokens, ids_crc32 (over 4-byte ids).

    A file is read whole by one task. A frame whose checksum fails stops the read.
    """
    columns = ["file", "row", "doc_id", "offset", "length", "n_tokens", "ids_crc32"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                for row, (offset, length, body) in enumerate(frames(content.as_buffer())):
                    ids = ids_of(body)
                    crc = 0 if index_only else zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((name, row, int.from_bytes(body[:8], "little", signed=True), offset, length, len(ids), crc))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=columns)

    out = _files(spark, path).mapInArrow(run, "file string, row long, doc_id long, offset long, length long, n_tokens long, ids_crc32 long")
    return out.drop("ids_crc32") if index_only else out


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the rows of the index that wanted holds (file, offset, length), in no order; other columns are left out.

    Only the files that hold one are opened, and in them only the frames asked for are read and
    checked. A row that stands twice in wanted gives its record twice; an empty table gives none.
    """
    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("places"))  # no more than a file's records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                found = [next(frames(view[p["offset"] : p["offset"] + p["length"]]))[2] for p in at]
                keys = pa.array([int.from_bytes(x[:8], "little", signed=True) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([ids_of(x).tolist() for x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _files(spark, path).join(places, "file").select("content", "places").mapInArrow(run, "doc_id long, ids array<long>")


def bases(index: DataFrame) -> DataFrame:
    """file and base: the ids in all files before it, in the order of the files' numbers (their names pad those to five digits only)."""
    from pyspark.sql.window import Window

    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("number", number)
    # One row for each file, of FILE_BYTES of text, goes through this window.
    before = Window.orderBy("number", "file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def placed(spark: SparkSession, path: str) -> DataFrame:
    """read() with start: the number of ids in all documents before it, over all files in order."""
    from pyspark.sql.window import Window

    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    base = bases(spark.read.parquet(f"{path}/index"))
    return read(spark, path).join(base, "file").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
