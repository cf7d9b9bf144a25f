import pytest

from threadlake.operators.transcript import shortened
from threadlake.sources import normal as N
from threadlake.sources.validation import issues, validated


def document(**changed):
    call = N.Entry("tool-call", N.MODEL, [N.Segment(N.MODEL, "x")], timestamp="2024-01-01T00:00:00.000Z", record="0:0", call_id="c", tool="t", namespace="n")
    result = N.Entry("tool-result", N.TOOL, [N.Segment(N.TOOL, content_class="image", source_type="input-image")], related=0)
    for k, v in changed.items():
        setattr(call, k, v)
    return N.Document([call, result], [("parent", "up")], "complete")


def test_a_good_document_passes():
    assert issues(document(), "me") == [] and validated(document(), "me").coverage == "complete"


@pytest.mark.parametrize(
    "changed,issue",
    [
        ({"timestamp": "2024-01-01"}, "timestamp"), ({"timestamp": "2024-13-01T00:00:00.000Z"}, "timestamp"), ({"related": 0}, "related-entry"), ({"related": 2}, "related-entry"), ({"related": -1}, "related-entry"),
        ({"kind": "message"}, "tool-identity"), ({"tool": None}, "tool-identity"), ({"kind": ""}, "entry-kind-or-actor"), ({"evidence": ("robot", "model", "high")}, "entry-kind-or-actor"),
        ({"content": [N.Segment(("model", "nowhere", "high"), "x")]}, "evidence"), ({"content": [N.Segment(N.MODEL)]}, "segment-variant"), ({"content": [N.Segment(N.MODEL, "x", "image", "y")]}, "segment-variant"),
        ({"content": [N.Segment(N.MODEL, content_class="image", source_type="Not so")]}, "segment-type"), ({"content": [N.Segment(N.MODEL, "\ud800")]}, "lone-surrogate"), ({"call_id": "\udfff"}, "lone-surrogate"),
    ],
)
def test_an_entry_that_breaks_a_rule(changed, issue):
    assert issues(document(**changed), "me") == [f"entry 0: {issue}"]
    with pytest.raises(N.Malformed):
        validated(document(**changed), "me")


def test_what_concerns_the_whole():
    doc = document()
    doc.coverage, doc.relations = "some", [("parent", "me"), ("parent", "me"), ("sibling", "x")]
    assert issues(doc, "me") == ["coverage", "relation", "relation-repeated", "relation-to-self"] and issues(document(), "") == ["identity"]


def test_texts_are_cut_between_code_points():
    assert [shortened("aé中", k) for k in range(7)] == ["", "a", "a", "aé", "aé", "aé", "aé中"]
