"""What an operator leaves on disk while it runs, and how much of a table goes to Python at once."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadlake.llm import bpe, line_dedup, store


def _tables(spark) -> set[str]:
    at = Path(store.shared_dir(spark).removeprefix("file:")) / "threadlake"
    return {p.name.rsplit("-", 1)[0] + p.name[-8:] for p in at.iterdir()} if at.exists() else set()


def _shuffles(spark) -> int:
    return len(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split("shuffle_")) - 1


def test_saved_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffles(spark), spark.conf.get(key)
    df = store.saved(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
    assert _shuffles(spark) <= before and spark.conf.get(key) == setting and df.count() == 7


def test_line_links_leave_only_what_their_result_reads(spark):
    line = "the quick brown fox jumps over the lazy dog and runs"
    docs = spark.createDataFrame([(1, line), (2, line + "s"), (3, "x" + line), (4, "something else that stands here all alone")], "doc_id long, text string")
    of = store.saved(line_dedup.forms(docs), "forms")
    before = _tables(spark)
    found = line_dedup.links(docs, of)
    left = {n[:-8] for n in _tables(spark) - before}
    assert "linked" in left and not left & {"shared", "nodes", "texts", "members", "tried", "links", "open", "held", "crossing"}
    assert found.count() == 3 and found.select("component").distinct().count() == 1


def test_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    bpe.store.small_batches(spark)
    assert spark.conf.get(key) == str(store.TEXT_ROWS)
    spark.conf.set(key, "77")
    bpe.store.small_batches(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)


def test_lines_that_share_a_piece_by_chance_are_not_members(spark, monkeypatch):
    """Lines of one length that share a long piece and nothing else meet in its key; none of them is sorted, joined or written any further."""
    docs = spark.createDataFrame([(i, "internationalised organs " + (chr(97 + i) * 7 + " ") * 6) for i in range(20)] + [(90, "q" * 40 + " these two are near"), (91, "q" * 40 + " these two are neat")], "doc_id long, text string")
    written, saved = {}, store.saved

    def counted(df, label):
        out = saved(df, label)
        written.setdefault(label, []).append(out.select("id").distinct().count() if label in ("members", "open") else out.count())
        return out

    monkeypatch.setattr(store, "saved", counted)
    found = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(docs).collect()}
    assert found == {i: i for i in range(20)} | {90: 90, 91: 90}
    assert written["nodes"] == [22] and written["members"] == [2] and written["open"] == [0, 0]


@pytest.mark.parametrize("most,indexed", [(500_000, 6), (1, 7), (0, 11)])
def test_a_line_is_indexed_once(spark, monkeypatch, most, indexed):
    """Of a line's copies the first stands for all, however few they are; where not all firsts can be broadcast, of those with the most copies."""
    line = "the line number {} that stands here, long enough".format
    docs = [(2, line("a")), (1, f"{line('b')}\n{line('a')}\n{line('c')}"), (3, f"{line('d')}\n{line('b')}\n{line('b')}\n{line('e')}"), (4, f"{line('b')}\n{line('f')}\n{line('b')}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    of = store.saved(line_dedup.forms(df), "forms")
    found = {(r.doc_id, r.line_no) for r in line_dedup._indexed_lines(df, of, 25).collect()}
    firsts = {tuple(r["first"]) for r in of.collect()}
    assert len(found) == indexed and firsts <= found


def test_long_ends_that_lines_share_are_cut_off(spark):
    df = spark.createDataFrame([("x" * 60_000 + "ab" + "y" * 60_000, "x" * 60_000 + "b" + "y" * 60_000)], "p string, t string")
    m = df.select(line_dedup.trimmed(F.col("p"), F.col("t")).alias("m")).select("m.*").first()
    assert len(m.p) < 32 and len(m.p) - len(m.t) == 1
