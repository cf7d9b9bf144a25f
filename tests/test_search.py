import random
import sqlite3

import pytest

from threadlake.operators import entries, excerpts, search
from threadlake.operators.library import SCHEMAS, empty
from threadlake.operators.service import Engine
from threadlake.plans.requests import EntriesRequest, EntryFilter, ListRequest, SearchRequest, UsageError

TEXTS = [
    ["alpha beta alpha", "gamma"], ["beta gamma beta beta gamma"], ["alpha", "beta"], ["Ålpha café x_y"], ["abc:123@v1 alpha. beta gamma"], [""],
    ["delta " * 100 + "alpha"], ["alpha beta alpha"],
]


@pytest.fixture(scope="module")
def library(spark):
    import hashlib

    ids = [("test", "one", f"n{i}") for i in range(len(TEXTS))]
    made = {
        "sources": [("test", "one", "complete", None)],
        "tracking": [(*i, "v", "d", "1", "v", "d", "1", "succeeded", None, "present", None, None, None) for i in ids],
        "documents": [(*i, "complete", None, None, None, None if k % 2 else f"2024-01-0{k + 1}T00:00:00.000Z", "digest") for k, i in enumerate(ids)],
        "entries": [(*i, o, "message", "human" if o else "model", None, None, None, None, None, "u", None) for i in ids for o in range(3)],
        "occurrences": [(*i, k % 2, k, hashlib.sha256(t.encode()).hexdigest(), None, None, "human" if k else "model", "high", None) for i, ts in zip(ids, TEXTS) for k, t in enumerate(ts)],
        "contents": list({t: (hashlib.sha256(t.encode()).hexdigest(), t) for ts in TEXTS for t in ts}.values()),
    }
    base = empty(spark)
    return base.with_tables(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in made.items()})


@pytest.mark.parametrize("text,mode", [("alpha", "all"), ("alpha beta", "all"), ("alpha beta", "any"), ("alpha alpha", "all"), ("x_y", "all"), ("abc:123@v1", "any"), ("alpha !!!", "any"), ("alpha !!!", "all"), ("CAFE", "all")])
def test_scores_agree_with_fts5(library, text, mode):
    rows = {r.digest: r.text for r in library["contents"].collect()}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(d UNINDEXED, x, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows.items())
    quoted = (" AND " if mode == "all" else " OR ").join('"' + t + '"' for t in text.split())
    expected = dict(db.execute("SELECT d, bm25(t) FROM t WHERE t MATCH ?", (quoted,)).fetchall())
    got = {r.digest: r.score for r in search.scored(library, text, mode).collect()}
    assert got == pytest.approx(expected, rel=1e-9)


def test_hits_order_support_and_terms(library):
    engine = Engine(library)
    out = engine.search(SearchRequest("alpha gamma", mode="any", context=1))
    assert out["support"] == {"occurrences": 8, "distinct_texts": 7, "known_roots": 7, "unknown_lineage": 0}
    keys = [(h["native_id"], h["ordinal"]) for h in out["hits"]]
    scores = [h["score"] for h in out["hits"]]
    assert scores == sorted(scores) and len(set(keys)) == len(keys)
    by = {k: h for k, h in zip(keys, out["hits"])}
    assert by[("n1", 0)]["matched_terms"] == ["gamma"] and by[("n4", 0)]["matched_terms"] == ["alpha", "gamma"]
    assert [c["context_ordinal"] for c in by[("n1", 0)]["context"]] == [1]
    # Equal texts score alike, and the later activity stands first: n0 has a time, n7 none.
    assert keys.index(("n0", 0)) < keys.index(("n7", 0)) and by[("n0", 0)]["score"] == by[("n7", 0)]["score"]


def test_origin_filters_segments_in_search_and_entries_by_any_segment(library):
    found = {(r.native_id, r.ordinal) for r in search.matching(library, "gamma", EntryFilter(origin="human")).collect()}
    assert found == {("n0", 1)}
    assert {(r.native_id, r.ordinal) for r in entries.selected(library, EntryFilter(origin="human")).collect()} == {("n0", 1), ("n2", 1)}


def test_pages_meet_every_row_once(library):
    engine = Engine(library)
    whole = [c["native_id"] for c in engine.list(ListRequest(limit=200))["conversations"]]
    seen, cursor = [], None
    while True:
        page = engine.list(ListRequest(limit=3, cursor=cursor))
        seen += [c["native_id"] for c in page["conversations"]]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert seen == whole and len(whole) == len(TEXTS)
    seen, cursor = [], None
    while True:
        page = engine.entries(EntriesRequest(limit=7, cursor=cursor))
        seen += [(e["native_id"], e["ordinal"]) for e in page["entries"]]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert seen == sorted(seen) and len(seen) == 3 * len(TEXTS)
    first = engine.list(ListRequest(limit=3))["next_cursor"]
    with pytest.raises(UsageError):
        engine.entries(EntriesRequest(limit=3, cursor=first))


def test_snippets_are_bounded_and_hold_the_match(spark):
    long = "word " * 300 + "end. Start of needle here. " + "tail " * 300
    wide = "中" * 400 + " needle " + "中" * 400
    texts = {"long": long, "short": "a needle", "wide": wide, "emoji": "😀€" * 90 + "needle" + "😀€" * 90, "none": "中" * 300, "empty": "", "null": None}
    rows = {r.digest: (r.snippet, r.snippet_truncated) for r in excerpts.excerpts(spark.createDataFrame(list(texts.items()), "digest string, text string"), [["needle"]]).collect()}
    for name in ("long", "wide", "emoji"):
        text, cut = rows[name]
        assert cut and "needle" in text and len(text.encode()) <= 512
    assert rows["long"][0].startswith(" … Start of needle here. tail") and rows["short"] == ("a needle", False)
    # A quarter of the bytes, in whole characters, stands before the occurrence.
    assert len(rows["wide"][0].split("needle")[0].encode()) in range(126, 129) and len(rows["emoji"][0].split("needle")[0].encode()) in range(123, 129)
    assert rows["none"] == ("中" * 170, True) and rows["empty"] == ("", False) and rows["null"] == (None, None)
    assert excerpts.excerpts(spark.createDataFrame([("a", "b c")], "digest string, text string"), []).first().snippet == "b c"


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "beta:gamma alpha", "alpha alpha gamma", "beta:beta gamma", "rare alpha:beta", "caf\u00e9 rare"])
def test_excerpts_are_those_of_fts5(spark, query):
    """Generated texts of few words with sentences, repeats and letters of several bytes: the window is the one that SQLite's snippet() takes."""
    draw = random.Random(query)
    words = ["alpha", "beta", "gamma", "rare", "café", "Ålpha", *[f"w{i}" for i in range(draw.choice([6, 60]))]]
    weights = [3, 3, 2, 1, 1, 1, *[8 if len(words) < 20 else 3] * (len(words) - 6)]
    marks = [" "] * 12 + [". ", ": ", ".", ", ", " \n", "。 ", ":\t", "  "]
    made = []
    for n in range(150):
        text = "".join(w + draw.choice(marks) for w in draw.choices(words, weights, k=draw.choice([1, 5, 63, 64, 65, 66, 80, 130, 400])))
        made.append((str(n), draw.choice(["", " ", "... "]) + text + draw.choice(["", "\n", "end"])))
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(d UNINDEXED, x, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", made)
    expected = dict(db.execute("SELECT d, snippet(t, 1, '', '', ' … ', 64) FROM t WHERE t MATCH ?", (" OR ".join('"' + t + '"' for t in query.split()),)).fetchall())
    texts = spark.createDataFrame(made, "digest string, text string")
    got = {r.digest: r for r in excerpts.excerpts(texts, [search.token_list(t) for t in query.split()]).collect()}
    assert len(expected) > 50 and {d: got[d].excerpt for d in expected} == expected
    whole = dict(made)
    for d, r in got.items():
        assert len(r.snippet.encode()) <= 512 and r.snippet_truncated == (r.snippet != whole[d])
        if len(r.excerpt.encode()) <= 512 and d in expected:
            assert r.snippet == r.excerpt
