"""A library that was written with some derived tables only, and the postings made in blocks of texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlake import queries
from threadlake.functions import columns as C
from threadlake.operators import search
from threadlake.operators.library import DERIVED, Store
from threadlake.sources import tables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_derived_tables_are_made_when_they_are_wanted(spark, tmp_path):
    """What wasn't asked for isn't written, isn't read as empty, and is the same as in a whole commit when it comes."""
    whole = Store(spark, str(tmp_path / "whole")).commit(tables.library(spark, SF))
    store = Store(spark, str(tmp_path / "part"))
    part = store.commit(tables.library(spark, SF), derived=("metrics",))
    assert set(part.tables) & set(DERIVED) == {"metrics"} and not (tmp_path / "part" / "postings").exists()
    assert _rows(queries.search_phrase(part)) == _rows(queries.search_phrase(whole))
    part = store.derive(("postings", "blocks", "corpus", "roots"))
    assert set(part.tables) & set(DERIVED) == {"metrics", "postings", "blocks", "corpus", "roots"} and store.derive(("roots",)).generation == part.generation
    part = store.derive(tuple(DERIVED))
    for name in DERIVED:
        assert _rows(part[name]) == _rows(whole[name]), name
    # The base tables are those of the first commit, not written again.
    assert {g for g, _ in store.manifest()["parts"]["contents"]} == {1}


def test_a_change_to_a_part_of_the_derived_tables_is_written_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    part = store.commit(tables.library(spark, SF), derived=("metrics",))
    kept = part.with_tables(contents=part["contents"].where("digest < '8'"))
    after = store.commit(kept)
    assert set(DERIVED) <= set(after.tables) and after["corpus"].first()["texts"] == kept["contents"].count()


TEXTS = ["b a b", "", "...", "Ä ä a", "a " * 40 + "z", "é" * 30 + " 𝒳 b", "b a b b"]
COLUMNS = ["term", "digest", "length", "positions"]


def test_postings(spark):
    df = spark.createDataFrame([(f"{i:064x}", t) for i, t in enumerate(TEXTS)], "digest string, text string")
    # Plainly: a row for each token, grouped.
    each = df.select("digest", C.tokens(F.col("text")).alias("t")).select("digest", F.size("t").cast("long").alias("length"), F.posexplode("t").alias("p", "term"))
    wanted = each.groupBy("term", "digest", "length").agg(F.sort_array(F.collect_list("p")).alias("positions"))
    got = search.postings(df, 3)
    assert _rows(got.select(COLUMNS)) == _rows(wanted.select(COLUMNS)) and wanted.count() > 8
    assert search.totals(df, got).first() == search.corpus(search.lengths(df)).first()


@pytest.mark.parametrize("most", [1, 7, 1 << 19])
def test_postings_in_blocks_of_any_size(monkeypatch, most):
    monkeypatch.setattr(search, "GROUP_TOKENS", most)
    tokens = [["b", "a", "b"], None, [], ["ä", "ä", "a"], ["a"] * 40 + ["z"], ["b", "a"], []]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(tokens))]), pa.array(tokens, pa.list_(pa.string()))], ["digest", "tokens"])
    got = sorted(tuple(r[c] for c in COLUMNS) for part in (batch, batch.slice(3, 3)) for b in search._grouped(iter([part])) for r in b.to_pylist())
    of = lambda i: [(t, str(i), len(tokens[i]), [k for k, x in enumerate(tokens[i]) if x == t]) for t in sorted(set(tokens[i] or []))]
    assert got == sorted(row for i in [*range(len(tokens)), 3, 4, 5] for row in of(i))


def test_a_search_without_an_index_tokenises_for_its_hits_once(spark):
    """Weights and hits come from the same counts, so the hits' own plan has no tokens left to make."""
    found = search.scored(tables.library(spark, SF), "the and", "any")
    plan = found._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "phrase-counts" in plan and found.count() > 0
