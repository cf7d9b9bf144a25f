"""The corpus pipeline: documents in, tokenised clean documents out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of documents, further ones and such of names that
the operators use inside included. Of an empty table nothing is left, by no stage an error.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadlake.llm import bpe, decontaminate, line_dedup, near_dup, quality, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones.

    A null or empty text is scored like any other; repeated rows are each judged alike.
    Without labels of both classes, the share of good labels (a half without any) is every score.
    """
    return quality.accepted(docs, quality.fit(docs, store.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines, and of copies of shorter ones, only the first in the corpus stays.

    A row without a doc_id keeps its text; of repeated rows, both keep the lines that are first
    in the corpus, as they can't be told apart. A text may end up empty; its row stays.
    """
    return line_dedup.without_repeated_lines(docs, copies_from=line_dedup.NOT_BLANK)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest doc_id.

    Texts without words are no one's duplicates; rows without a doc_id stay, and rows that
    share a doc_id stay or go together.
    """
    return near_dup.without_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts and items contain nothing and are in nothing; rows without an id stay.
    """
    return decontaminate.without_leaks(docs, decontaminate.find(docs, store.table(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, of every row; a null text counts as empty."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", tokenise),
]

#: The classifier and the library's token ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result but the last is written to the shared folder and read again."""
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
