"""Documents merged from bucketed tables, against those put together by joins."""

from threadlake.operators import clustered, transcript
from threadlake.sources import shared, tables


def test_documents_are_merged_without_an_exchange(spark):
    library = tables.library(spark, "/root/testdata/sf0.001")
    path = shared.fresh_path(spark, "clustered")
    made = clustered.Clustered.write(library, path, 3)
    for plan in (made.nested(), made.digests()):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and text.count("Bucketed: true") == 4
    shape = lambda df: {tuple(r[c] for c in ("source_kind", "instance_id", "native_id")): r.asDict(recursive=True) for r in df.collect()}
    assert shape(made.nested()) == shape(transcript.nested(library).select(made.nested().columns))
    own = {tuple(r)[:4] for r in made.digests().collect()}
    assert own == {tuple(r)[:4] for r in transcript.document_digests(library).collect()}
    made.close()
    again = clustered.Clustered.open(spark, path, 3)
    assert {tuple(r)[:4] for r in again.digests().collect()} == own
    again.close()


def test_buckets_follow_the_bytes(spark, monkeypatch):
    library = tables.library(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(clustered, "BUCKET_BYTES", 10_000)
    made = clustered.Clustered.write(library, shared.fresh_path(spark, "clustered"))
    assert made.buckets > 8 and made.table("documents").count() == library["documents"].count()
    made.close()
