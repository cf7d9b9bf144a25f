"""Search over a stored index against scoring every text."""

import hashlib
import random
from dataclasses import replace

import pytest

from threadlake.functions import columns as C
from threadlake.operators import maintenance, search, topk
from threadlake.operators.library import SCHEMAS, Store, empty
from threadlake.plans.requests import EntryFilter

RND = random.Random(3)
WORDS = [f"w{i}" for i in range(60)]


def texts(n):
    """Of many lengths; few hold the rare words, and some hold one word very often."""
    out = []
    for i in range(n):
        size = RND.choice((3, 8, 8, 20, 20, 20, 60, 200))
        words = [RND.choice(WORDS[: RND.choice((5, 60))]) for _ in range(size)]
        if i % 50 == 0:
            words += ["w7"] * (size * 2)
        if i % 97 == 0:
            words += ["rare", "pair"]
        out.append(" ".join(words))
    return out


def made(spark, n=1500):
    ids = [("test", "one", f"n{i:05}") for i in range(n)]
    said = texts(n)
    said[5:200:5] = [said[0]] * 39
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {
        "sources": [("test", "one", "complete", None)],
        "tracking": [(*i, "v", "d", "1", "v", "d", "1", "succeeded", None, "present", None, None, None) for i in ids],
        "documents": [(*i, "complete", None, "even" if k % 2 else "odd", None, f"2024-01-{k % 28 + 1:02}T00:00:00.000Z" if k % 3 else None, "digest") for k, i in enumerate(ids)],
        "entries": [(*i, o, "message", "human" if o else "model", None, None, None, None, None, "u", None) for i in ids for o in range(2)],
        "occurrences": [(*i, o, s, sha(t), None, None, "human" if o else "model", "high", None) for k, i in enumerate(ids) for o, s, t in ((0, 0, said[k]), (1, 0, said[k - 1]), (1, 1, f"w3 tail {k}"))],
        "contents": [(sha(t), t) for t in {*said, *(f"w3 tail {k}" for k in range(n))}],
    }
    return empty(spark).with_tables(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()})


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    before, search.BLOCK_TEXTS = search.BLOCK_TEXTS, 64
    try:
        store = Store(spark, str(tmp_path_factory.mktemp("topk") / "lib"))
        store.commit(made(spark))
    finally:
        search.BLOCK_TEXTS = before
    return store


CASES = [
    ("w7", "all", EntryFilter(), 20, 0), ("w7 w3", "all", EntryFilter(), 20, 0), ("w7 w30", "any", EntryFilter(), 10, 15), ("rare:pair w7", "any", EntryFilter(), 5, 0), ("rare pair", "all", EntryFilter(), 30, 0),
    ("w3", "all", EntryFilter(origin="human"), 10, 0), ("w7", "any", EntryFilter(workspace="even", actor="model"), 10, 0), ("w7 w7", "any", EntryFilter(), 5, 0), ("nowhere", "any", EntryFilter(), 5, 0), ("nowhere w7", "all", EntryFilter(), 5, 0),
    ("w7 !!!", "any", EntryFilter(), 5, 0), ("w7 !!!", "all", EntryFilter(), 5, 0), ("rare", "all", EntryFilter(), 20, 5000),
]


@pytest.mark.parametrize("text,mode,f,limit,offset", CASES)
def test_pages_are_those_of_all_scores(stored, text, mode, f, limit, offset):
    library = stored.open()
    every = search.hits(search.matching(library, text, f, mode), text, mode).orderBy(*search.order()).offset(offset).limit(limit + 1)
    shape = lambda df: [(*[r[k] for k in (*search.E.KEY, "segment_ordinal", "digest", "activity", "additional_segments", "matched_terms")], round(r["score"], 9)) for r in df.collect()]
    assert shape(search.page(library, text, f, mode, limit, offset)) == shape(every)


def test_blocks_are_left_out(stored):
    """A page of a common word reads few of its blocks, postings by term and block and places by digest, and no table of all lengths."""
    library = stored.open()
    found = topk.page(library, "w7", limit=5)
    assert found.blocks > 40 and found.blocks_read < found.blocks / 2
    index = search.index(library)
    few = index.postings.where(C.among("block", [3, 4])).where("term = 'w7'")
    plan = search.phrase_counts(replace(index, postings=few), [["w7"]])._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "Or(EqualTo(block,3),EqualTo(block,4))" in pushed and "EqualTo(term,w7)" in pushed and "lengths" not in plan
    plan = search.places(library).where(C.among("digest", ["a", "b"]))._jdf.queryExecution().toString()
    assert "Or(EqualTo(digest,a),EqualTo(digest,b))" in plan[plan.index("PushedFilters") :]


def test_bounds_hold(stored):
    """No text scores better than its block's bound."""
    library = stored.open()
    index = search.index(library)
    for text in ("w7", "w7 w3 w30", "rare:pair w1"):
        phrases = search.parsed(text, "any")
        idf = search.weights(index, search.text_counts(index, phrases))
        scores = search.rated(search.phrase_counts(index, phrases), index, idf).where("score < 0").join(topk.bounds(index, phrases, idf, "any"), "block", "left")
        assert scores.count() > 0 and scores.where("bound IS NULL OR -score > bound + 1e-9").count() == 0


def test_totals_follow_what_goes(spark, stored):
    """Texts that were dropped leave the numbers of texts, tokens and texts by term as if they had never been there."""
    store = Store(spark, stored.path)
    for n in ("n00049", "n00050", "n00051", "n00700"):
        store.commit(maintenance.forget(store.open(), ("test", "one", n)))
    kept = store.open()
    now, anew = search.index(kept), search.index(kept.with_tables(contents=kept["contents"]))
    assert (now.texts, now.mean_length) == (anew.texts, pytest.approx(anew.mean_length)) and now.stored and not anew.stored
    count = lambda i: {r["term"]: r["n"] for r in i.blocks.groupBy("term").agg({"texts": "sum"}).withColumnRenamed("sum(texts)", "n").collect() if r["n"]}
    assert count(now) == count(anew)
    test_pages_are_those_of_all_scores(store, "w7 w30", "any", EntryFilter(), 10, 0)
