"""What a stored library takes on disk while it is written and afterwards."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threadlake import queries
from threadlake.operators import maintenance, search
from threadlake.operators.library import SCHEMAS, Store, empty
from threadlake.sources import shared, tables


def _library(spark, n=1200, words=60):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(words)) for _ in range(n)]
    contents = spark.createDataFrame([(t,) for t in texts], "text string").select(F.sha2("text", 256).alias("digest"), "text").distinct()
    return empty(spark).with_tables(contents=contents.select(SCHEMAS["contents"].replace(" string", "").split(", ")))


def test_a_posting_holds_no_digest_of_its_own(spark, tmp_path):
    library = Store(spark, str(tmp_path)).commit(_library(spark), derived=("postings", "blocks", "corpus"))
    files = list(tmp_path.rglob("postings/*.parquet"))
    rows = sum(pq.ParquetFile(f).metadata.num_rows for f in files)
    assert rows == library["postings"].count() > 60_000
    assert sum(f.stat().st_size for f in files) < 20 * rows  # 64 are a digest's
    keys = [list(zip(*pq.read_table(f, columns=["term", "block"]).to_pydict().values())) for f in files]
    assert all(k == sorted(k) for k in keys)


def test_blocks_are_counted_without_an_exchange(spark, tmp_path):
    library = Store(spark, str(tmp_path)).commit(_library(spark), derived=("postings", "blocks", "corpus"))
    assert "Exchange" not in search.partial_blocks(library["postings"])._jdf.queryExecution().executedPlan().toString()
    summed = library["blocks"].groupBy("term", "block").agg(F.sum("texts").alias("texts"), F.max("most").alias("most"), F.min("least").alias("least"))
    wanted = search.blocks(library["postings"])
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, wanted.collect()))


def test_runs_of_postings_are_sorted(spark):
    made = search.postings(_library(spark)["contents"].coalesce(1), 4).collect()
    assert [(r.term, r.block) for r in made] == sorted((r.term, r.block) for r in made)


def test_shuffle_files_go_with_their_step(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name, None), []
    store = Store(spark, str(tmp_path))
    put = store._put
    store._put = lambda manifest: (seen.append(spark.conf.get(name)), put(manifest))
    store.commit(_library(spark, 20), derived=())
    assert seen == ["true"] and spark.conf.get(name, None) == before
    with shared.set_for(spark, "spark.sql.files.maxPartitionBytes", 1 << 20):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(1 << 20)


ROWS = [("a", "x"), ("a", "x"), ("a", None), ("b", "x"), ("b", "y"), ("b", "y"), (None, "x"), (None, None), ("c", "z"), ("d", "q"), ("d", "r")]


@pytest.mark.parametrize("left,right", [("k < 'b'", "k > 'a'"), ("v IS NOT NULL", "k <> 'c' OR k IS NULL"), ("k = 'd' AND v = 'q' OR k IS NULL", "k = 'd' AND v = 'r' OR v IS NULL"), ("true", "true"), ("false", "true")])
def test_differences_by_key(spark, left, right):
    """The same as comparing all rows one by one, with repeats, nulls, and keys of which each side has other rows."""
    rows = spark.createDataFrame(ROWS, "k string, v string")
    wanted = maintenance.difference(rows.where(left), rows.where(right)).groupBy("side", "k").agg(F.count("*").alias("n"))
    got = maintenance.key_differences(rows, F.expr(left), F.expr(right), "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_a_projection_shuffles_no_terms(spark, monkeypatch):
    plans = []
    saved = shared.saved
    monkeypatch.setattr(shared, "saved", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, label))
    found = queries.projection_diff(tables.library(spark, "/root/testdata/sf0.001"))
    assert found.count() > 50 and found.columns == ["side", "digest", "n"]
    assert len(plans) == 1 and not re.search(r"hashpartitioning\([^)]*term", plans[0] + found._jdf.queryExecution().executedPlan().toString())
