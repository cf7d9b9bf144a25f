"""Reads of a part of a stored conversation, proven by its blocks."""

import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from threadlake.functions import columns as C
from threadlake.operators import doctor, maintenance, output, proof, transcript
from threadlake.operators.library import SCHEMAS, Store, empty
from threadlake.plans.requests import OperationError, TranscriptRequest

N = 1000
ID = ("test", "one", "long")


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = [f"entry {i} " + "é" * (i % 7) for i in range(N)]
    other = ("test", "one", "short")
    rows = {
        "sources": [("test", "one", "complete", None)],
        "tracking": [(*i, "v", "d", "1", "v", "d", "1", "succeeded", None, "present", None, None, None) for i in (ID, other)],
        "documents": [(*i, "complete", "Title", None, None, None, sha(i[2])) for i in (ID, other)],
        "relations": [(*ID, o, "fork", "test", "one", f"t{o}", "high") for o in range(60)],
        "entries": [(*ID, o, "message", "human", None, None, None, None, None, "u", None) for o in range(N)] + [(*other, 0, "message", "human", None, None, None, None, None, "u", None)],
        "occurrences": [(*ID, o, 0, sha(t), None, None, "human", "high", None) for o, t in enumerate(texts)] + [(*ID, 5, 1, None, "image", "input-image", "human", "high", None), (*other, 0, 0, sha(texts[0]), None, None, "human", "high", None)],
        "contents": [(sha(t), t) for t in texts],
    }
    store = Store(spark, str(tmp_path_factory.mktemp("proof") / "lib"))
    return store.commit(empty(spark).with_tables(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}))


def test_windows(library):
    shown = transcript.show(library, TranscriptRequest(ID, entry=500, context=2))
    assert [e["ordinal"] for e in shown["entries"]] == [498, 499, 500, 501, 502] and shown["entries"][2]["content"][0]["text"] == "entry 500 " + "é" * 3
    assert shown["selection"] == {"total_entries": N, "emitted_entries": 5, "omitted_entries": N - 5, "omitted_relations": 10} and len(shown["relations"]) == 50
    first = transcript.show(library, TranscriptRequest(ID))
    assert len(first["entries"]) == 50 and [len(e["content"]) for e in first["entries"][4:7]] == [1, 2, 1] and first["entries"][5]["content"][1]["text"] is None
    whole = transcript.show(library, TranscriptRequest(ID, full=True))
    assert len(whole["entries"]) == N and len(whole["relations"]) == 60
    with pytest.raises(OperationError, match="no such entry"):
        transcript.show(library, TranscriptRequest(ID, entry=N))


def changed(library, name, **columns):
    """The library with a changed table, as if its files had been changed: what is stored beside it stays."""
    return replace(library, tables=library.tables | {name: library[name].withColumns(columns)})


def test_a_changed_byte_fails(library):
    """Where it is in a block that is read, or in what covers all blocks; elsewhere it isn't even read."""
    ask = lambda lib, n: transcript.show(lib, TranscriptRequest(ID, entry=n, context=0))
    at = lambda n: F.col("ordinal") == n
    entry = changed(library, "entries", actor=F.when(at(300), "model").otherwise(F.col("actor")))
    segment = changed(library, "occurrences", origin=F.when(at(300), "model").otherwise(F.col("origin")))
    for lib in (entry, segment):
        assert ask(lib, 10)["entries"][0]["ordinal"] == 10
        with pytest.raises(OperationError, match="an entry"):
            ask(lib, 290)
        assert doctor.proofs(lib).collect() == [(*ID, 1)]
    for lib in (changed(library, "documents", title=F.lit("title")), changed(library, "relations", confidence=F.lit("low")), changed(library, "proofs", digest=F.when(F.col("block") == 3, "0").otherwise(F.col("digest")))):
        with pytest.raises(OperationError, match="a block digest"):
            ask(lib, 10)
    with pytest.raises(OperationError, match="a text"):
        ask(changed(library, "contents", text=F.replace("text", F.lit("entry 10 "), F.lit("entry 1O "))), 10)
    dropped = replace(library, tables=library.tables | {"entries": library["entries"].where(~at(299))})
    with pytest.raises(OperationError, match="an entry"):
        ask(dropped, 300)
    assert doctor.proofs(library).collect() == []


def test_scans_take_one_block(library):
    """The plan of a block's proof reads one conversation's rows of its ordinals: both reach the scans."""
    own = library.near(["long"])
    part = own.with_tables(entries=own["entries"].where("ordinal BETWEEN 256 AND 511"), occurrences=own["occurrences"].where("ordinal BETWEEN 256 AND 511"))
    plan = proof.blocks(part)._jdf.queryExecution().toString()
    scans = [p.split("ReadSchema")[0] for p in plan.split("PushedFilters")[1:]]
    assert len(scans) == 2 and all("EqualTo(native_id,long)" in p and "GreaterThanOrEqual(ordinal,25" in p for p in scans)


def test_ranges_find_what_differs(spark):
    rows = [(f"t{i % 300}", i, None if i % 3 else "x") for i in range(3000)]
    left = spark.createDataFrame(rows, "term string, n long, note string")
    assert maintenance.changed_ranges(left, left.repartition(7), "term") == [] and maintenance.difference(left, left.repartition(7), "term").collect() == []
    twice = left.unionByName(left.where("n = 5"))
    swapped = left.withColumn("note", F.when(F.col("n") == 7, "y").otherwise(F.col("note"))).where("n <> 8")
    for right, want in ((twice, {("right", 5)}), (swapped, {("left", 7), ("right", 7), ("left", 8)}), (left.where("term <> 't1'"), {("left", i) for i in range(1, 3000, 300)})):
        assert len(maintenance.changed_ranges(left, right, "term")) <= 2
        found = maintenance.difference(left, right, "term").collect()
        assert {(r.side, r.n) for r in found} == want and sorted(map(tuple, found), key=str) == sorted(map(tuple, maintenance.difference(left, right).collect()), key=str)


def test_export_of_a_whole_library(spark, library, tmp_path):
    """Every record once, numbered over all files in order; the bytes are known before anything is written, and a limit is held."""
    import json

    n, size = output.export_all(library, str(tmp_path / "all"))
    files = sorted((tmp_path / "all").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    told = [json.loads(line) for line in text.splitlines()]
    assert (len(told), len(text.encode())) == (n, size) and n == 2 + 60 + N + 1 and [t["record"] for t in told] == list(range(n))
    assert [t["type"] for t in told] == ["conversation"] + ["relation"] * 60 + ["entry"] * N + ["conversation", "entry"]
    assert told[61 + 5]["content"][0]["text"] == "entry 5 " + "é" * 5 and "text" not in told[61 + 5]["content"][1] and told[61]["conversation"] == "test@one:long"
    records = output.documents_as_lines(library)
    for limit in (size - 1, size):
        if limit < size:
            with pytest.raises(OperationError):
                output.write_lines(records, [*C.ID, "part", "ordinal"], str(tmp_path / f"{limit}"), limit)
        else:
            output.write_lines(records, [*C.ID, "part", "ordinal"], str(tmp_path / f"{limit}"), limit)
        assert (tmp_path / f"{limit}").exists() == (limit == size)
