import pytest
from hypothesis import given
from hypothesis import strategies as st

from threadlake.functions.canonical_json import canonical
from threadlake.plans import cursors
from threadlake.plans.requests import (
    ConversationFilter,
    EntriesRequest,
    EntryFilter,
    ListRequest,
    ManifestRequest,
    OperationError,
    SearchRequest,
    TranscriptRequest,
    UsageError,
    disclosed,
    fingerprint,
    search_terms,
)

DAY = "2024-04-05T00:00:00.000Z"


@pytest.mark.parametrize(
    "make",
    [
        lambda: ListRequest(limit=0),
        lambda: ListRequest(limit=201),
        lambda: ListRequest(limit=True),
        lambda: ListRequest(cursor="x" * 2049),
        lambda: SearchRequest("   "),
        lambda: SearchRequest("a " * 33),
        lambda: SearchRequest("x" * 4097),
        lambda: SearchRequest("a", mode="near"),
        lambda: SearchRequest("a", context=11),
        lambda: EntriesRequest(selection="second"),
        lambda: ConversationFilter(instance="i"),
        lambda: ConversationFilter(source_state="gone"),
        lambda: ConversationFilter(activity_after="2024-04-05"),
        lambda: ConversationFilter(activity_after="2024-02-30T00:00:00.000Z"),
        lambda: ConversationFilter(activity_after=DAY, activity_before=DAY),
        lambda: EntryFilter(actor="robot"),
        lambda: ManifestRequest(ConversationFilter(workspace="w")),
        lambda: TranscriptRequest(("a", "b", "c"), entry=1, full=True),
        lambda: TranscriptRequest(("a", "b", "c"), from_entry=0, to_entry=200),
        lambda: TranscriptRequest(("a", "b", "c"), context=2),
    ],
)
def test_requests_that_cannot_be_valid(make):
    with pytest.raises(UsageError) as e:
        make()
    assert e.value.exit_code == 2


def test_terms_split_on_unicode_white_space_and_keep_repeats():
    assert search_terms("a\u0085b　 a​c") == ["a", "b", "a​c"]


def test_disclosed_filters():
    f = EntryFilter(source="event", workspace="w", actor="human")
    assert disclosed(f) == (["source"], ["workspace", "actor"])


def test_fingerprint_ignores_page_size_and_spacing():
    assert fingerprint(SearchRequest("a  b", limit=5)) == fingerprint(SearchRequest("a b", limit=9, cursor="c"))
    assert fingerprint(SearchRequest("a b")) != fingerprint(SearchRequest("a b", mode="any"))


def test_cursor_outcomes():
    position = cursors.Position((None, "k", "ié", "n"), 0)
    cursor = cursors.encode("q", "lib", 3, position)
    assert cursors.decode(cursor, "q", "lib", 3) == position
    for bad in ("!", "e30", cursor[:10]):
        with pytest.raises(UsageError, match="read"):
            cursors.decode(bad, "q", "lib", 3)
    with pytest.raises(UsageError) as e:
        cursors.decode(cursor, "other", "lib", 4)  # mismatch is told before stale
    assert e.value.code == "cursor-mismatch"
    with pytest.raises(OperationError) as e:
        cursors.decode(cursor, "q", "lib", 4)
    assert e.value.code == "stale-cursor"


def test_canonical_json():
    value = {"€": 1, "דּ": 2, "\U0001f600": 3, "b": [True, None, "\u0007\n\"\\é "], "a": {}}
    assert canonical(value) == '{"a":{},"b":[true,null,"\\u0007\\n\\"\\\\é "],"€":1,"\U0001f600":3,"דּ":2}'
    for bad in (1.5, 1 << 53, "\ud800", {1: 2} if False else object()):
        with pytest.raises((ValueError, UnicodeEncodeError)):
            canonical(bad)


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**52), 2**52) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_canonical_json_reads_back(value):
    import json

    assert json.loads(canonical(value)) == value
