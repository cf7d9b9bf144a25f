"""How often queries without a stored index go over the texts, and that fewer passes find the same."""

import pytest
from pyspark.sql import functions as F

from threadlake.operators import maintenance, search
from threadlake.sources import tables

SF = "/root/testdata/sf0.001"
TEXTS = ["b a b", "", "...", "Ä ä a", "a " * 40 + "z", "é" * 30 + " 𝒳 b", "b a b b", "a a a"]


def _rows(df):
    return sorted(map(str, df.collect()))


def _texts(spark):
    return spark.createDataFrame([(f"{i:x}" * 64, t) for i, t in enumerate(TEXTS)], "digest string, text string")


def test_contents_need_no_places(spark):
    assert "Window" not in tables.library(spark, SF)["contents"]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text", ["a b", "a:a", "b:a:b zz", "a:a:a b:b"])
def test_one_pass_of_a_search(spark, monkeypatch, text):
    lib = tables.library(spark, SF).with_tables(contents=_texts(spark))
    index = search.index(lib)
    phrases = search.parsed(text, "any")
    counts = search.phrase_counts(index, phrases)
    tf = [f"tf_{i}" for i in range(len(phrases))]
    wanted = search.rated(search.matched(counts, len(phrases), "any"), index, search.weights(index, search.text_counts(index, phrases, counts))).select("digest", "score", *tf)
    monkeypatch.delattr(search, "lengths")  # totals come from the same pass
    found = search.scored(lib, text, "any")
    assert _rows(found.withColumn("score", F.round("score", 9))) == _rows(wanted.withColumn("score", F.round("score", 9))) and found.count() > 0


def test_vocabulary_of_two_parts_in_one_pass(spark):
    kept = search.postings(_texts(spark))
    for left, right in ((F.lit(True), F.col("digest") < "4"), (F.col("digest") < "5", F.col("digest") > "2"), (F.lit(False), F.lit(True))):
        got = search.vocabulary_difference_within(kept, left, right)
        assert _rows(got) == _rows(search.vocabulary_difference(kept.where(left), kept.where(right)).select(got.columns)) and got.count() > 0


def test_a_difference_counts_rows_once(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", None), ("c", 2)], "more string, n int")
    right = spark.createDataFrame([("a", 1), ("b", None), ("b", None), (None, 3)], "more string, n int")
    got = maintenance.difference(left, right)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, "left"), ("a", 1, "left"), ("c", 2, "left"), ("b", None, "right"), (None, 3, "right")], key=str)
