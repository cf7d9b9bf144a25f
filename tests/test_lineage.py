import pytest

from threadlake.operators import lineage
from threadlake.operators.library import SCHEMAS, empty


def solve(spark, nodes):
    """nodes: id -> (coverage, [(relation, target, confidence)])"""
    docs = [("k", "i", n, cov, None, None, None, None, "d") for n, (cov, _) in nodes.items()]
    rel = [("k", "i", n, o, r, "k", "i", t, c) for n, (_, rs) in nodes.items() for o, (r, t, c) in enumerate(rs)]
    lib = empty(spark).with_tables(documents=spark.createDataFrame(docs, SCHEMAS["documents"]), relations=spark.createDataFrame(rel, SCHEMAS["relations"]))
    return {r.native_id: r.root.native_id if r.root else None for r in lineage.roots(lib).collect()}


def test_rules(spark):
    up = lambda t, c="high", r="parent": (r, t, c)
    nodes = {
        "root": ("complete", []), "other": ("complete", []), "uncovered": ("unknown", []), "child-edge": ("complete", [up("other", r="child")]),
        "a": ("complete", [up("root")]), "b": ("complete", [up("a")]), "low": ("complete", [up("root", "low")]), "below-low": ("complete", [up("low")]),
        "unknown-kind": ("complete", [up("root", r="unknown")]), "gone": ("complete", [up("nowhere")]), "under-uncovered": ("complete", [up("uncovered")]),
        "converge": ("complete", [up("a"), up("root", r="fork")]), "diverge": ("complete", [up("a"), up("other")]), "self": ("complete", [up("self")]),
        "c1": ("complete", [up("c2")]), "c2": ("complete", [up("c1")]), "behind": ("complete", [up("c1")]), "half": ("complete", [up("a"), up("c1")]),
    }
    got = solve(spark, nodes)
    known = {"root": "root", "other": "other", "child-edge": "child-edge", "a": "root", "b": "root", "converge": "root"}
    assert got == {n: known.get(n) for n in nodes}


@pytest.mark.parametrize("n", [1000])
def test_long_chain(spark, n):
    nodes = {f"{i}": ("complete", [("parent", f"{i - 1}", "high")] if i else []) for i in range(n)}
    assert set(solve(spark, nodes).values()) == {"0"}
