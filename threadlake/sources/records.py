"""Lines of files, numbered from 0, however long the files are.

Spark splits a plain file into ranges of bytes, of which each is a task's work. The number
of a line follows from how many lines the ranges before it hold. A line over RECORD_BYTES
is passed over while it is read and never held; a file that lacks such a line, or isn't
UTF-8, gets one more line that isn't JSON, so its conversation is malformed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The longest record.
RECORD_BYTES = 32 * 1024 * 1024
#: The number and text of the line that makes a file malformed.
BAD_LINE, BAD = 1 << 40, "\x00"


def _plain(spark: SparkSession, paths: list[str], most: int) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", most + 1).text(paths)
    # What Spark calls a file is the URI of its path.
    named = spark.createDataFrame([(_uri(spark, p), p) for p in paths], "uri string, path string")
    raw = text.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("uri"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    ranges = raw.groupBy("uri", "start").agg(F.count("*").alias("lines"), F.min("at").alias("first"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.bool_and(F.is_valid_utf8("value") & (F.octet_length("value") <= most)).alias("valid"))
    before = Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.withColumn("offset", F.coalesce(F.sum("lines").over(before), F.lit(0))).select("uri", "start", "first", "offset")
    line = F.nullif(F.regexp_replace("value", "\r+$", ""), F.lit(""))
    numbered = raw.where(F.is_valid_utf8("value")).join(known, ["uri", "start"]).select("uri", (F.col("offset") + F.col("at") - F.col("first")).alias("no"), line.alias("line"))
    # A line that is too long is cut where its range ends, or missing from the bytes, of which nothing else can lack as many.
    bad = ranges.groupBy("uri").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.bool_and("valid").alias("valid")).where(f"NOT valid OR size - bytes >= {most}")
    both = numbered.unionByName(bad.select("uri", F.lit(BAD_LINE).alias("no"), F.lit(BAD).alias("line")))
    return both.join(named, "uri").select("path", "no", "line")


def _uri(spark: SparkSession, path: str) -> str:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target)
    return re.sub("^file:/+", "file:/", whole.toUri().toString())


def _packed(spark: SparkSession, paths: list[str], most: int) -> DataFrame:
    """Files of zstd frames can't be split: each is one task's work, and streamed there."""

    def lines(batches) -> Iterator:
        import io

        import pandas as pd
        import zstandard

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                reader, out, no = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content))), [], 0
                try:
                    while raw := reader.readline(most + 2):
                        if len(raw.rstrip(b"\r\n")) > most:
                            raise ValueError("a record is too long")
                        out.append((path, no, raw.rstrip(b"\r\n").decode() or None))
                        no += 1
                        if len(out) == 1000:
                            yield pd.DataFrame(out, columns=["path", "no", "line"])
                            out = []
                except (ValueError, zstandard.ZstdError):
                    out.append((path, BAD_LINE, BAD))
                if out:
                    yield pd.DataFrame(out, columns=["path", "no", "line"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(lines, "path string, no long, line string")


def lines(spark: SparkSession, paths: list[str], most: int = RECORD_BYTES) -> DataFrame:
    """path, no and line (null where it is empty) of every line of the files; line feeds end lines, and carriage returns before them are cut."""
    plain, packed = [p for p in paths if not p.endswith(".zst")], [p for p in paths if p.endswith(".zst")]
    made = [make(spark, some, most) for make, some in ((_plain, plain), (_packed, packed)) if some]
    if not made:
        return spark.createDataFrame([], "path string, no long, line string")
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])
