import sqlite3

import pytest
from pyspark.sql import functions as F

from threadlake.functions import columns as C


def rows(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


TEXTS = ["", "a", "héllo", "中文字", "\U0001f600\U0001f600", "abé", "é" * 5, None]


@pytest.mark.parametrize("most", range(0, 9))
def test_truncated_utf8(spark, most):
    def expected(t):
        if t is None:
            return None
        raw = t.encode()[:most]
        return raw.decode("utf-8", "ignore")

    assert rows(spark, TEXTS, lambda c: C.truncated_utf8(c, most)) == [expected(t) for t in TEXTS]


def test_identity_round_trip(spark):
    names = ["profile/primary:α", "a b+c~*", "100%", "-._", "x@y"]
    df = spark.createDataFrame([("codex", n, n[::-1]) for n in names], "source_kind string, instance_id string, native_id string")
    got = df.select(C.printable_identity(*[F.col(c) for c in C.ID]).alias("p")).select("p", C.parsed_identity(F.col("p")).alias("r")).collect()
    assert [(r.r.instance_id, r.r.native_id) for r in got] == [(n, n[::-1]) for n in names]
    assert got[0].p == "codex@profile%2Fprimary%3A%CE%B1:%CE%B1%3Ayramirp%2Feliforp"
    bad = ["codex@a b:c", "codex@a%2f:c", "Codex@a:b", "codex@a:", "codex@%zz:b", "codex@a:b:c"]
    assert rows(spark, bad, C.parsed_identity) == [None] * len(bad)


def test_canonical_timestamps(spark):
    values = ["2024-02-29T23:59:59.999Z", "2023-02-29T00:00:00.000Z", "2024-01-01T00:00:00Z", "2024-01-01T24:00:00.000Z", "", None]
    assert rows(spark, values, C.is_canonical_timestamp) == [True, False, False, False, False, None]


def test_tokens_agree_with_sqlite(spark):
    """The fold and token rules against SQLite's own unicode61 tokenizer, over Latin letters and odd texts."""
    letters = [chr(c) for c in [*range(0x21, 0x250), *range(0x1E00, 0x1F00)] if chr(c).isprintable()]
    texts = letters + ["abc:123@v1", "x_y", "ÅNGSTRÖM ß ø đ ł", "Σςσ", "don't  stop", "中文", "!!!", "1½2"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    for i, t in enumerate(texts):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i + 1, t))
    expected = {i: [] for i in range(len(texts))}
    for term, doc, _, _ in db.execute("SELECT * FROM v ORDER BY doc, offset"):
        expected[doc - 1].append(term)
    got = rows(spark, texts, C.tokens)
    different = [(texts[i], got[i], expected[i]) for i in range(len(texts)) if got[i] != expected[i]]
    # Letters that newer Unicode tables fold or class otherwise than SQLite's own are few and named here.
    assert len(different) <= 6, different[:20]
