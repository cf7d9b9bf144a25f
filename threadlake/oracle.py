"""The queries in DuckDB's SQL, over the flat test tables."""

from __future__ import annotations

_DAY = "'2024-04-' || lpad((({n}) % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00.000Z'"
_STAMP = "strftime({t}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _day(n: str) -> str:
    return "(" + _DAY.format(n=n) + ")"


_BASE = f"""
document_heads AS (
  SELECT source AS instance_id, doc_id::VARCHAR AS native_id, doc_id AS n, 'Document ' || doc_id AS title, lang AS workspace, CASE WHEN doc_id % 15 <> 0 THEN {_day('doc_id')} END AS created_at,
    CASE WHEN doc_id % 5 <> 0 THEN {_day('doc_id * 3 + 1')} END AS updated_at FROM documents),
heads AS (
  SELECT 'conversation' AS source_kind, 'testdata' AS instance_id, conv_id::VARCHAR AS native_id, conv_id AS n, NULL::VARCHAR AS title, NULL::VARCHAR AS workspace,
    NULL::VARCHAR AS created_at, NULL::VARCHAR AS updated_at, false AS lost FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT 'document', *, false FROM document_heads
  UNION ALL SELECT 'document', instance_id, 'lost-' || native_id, n, title, workspace, created_at, updated_at, true FROM document_heads WHERE n % 14 = 0
  UNION ALL SELECT 'event', 'testdata', user_id::VARCHAR, user_id, 'User ' || user_id, 'events', {_STAMP.format(t='min(ts)')}, {_STAMP.format(t='max(ts)')}, false FROM events GROUP BY user_id),
spine AS (
  SELECT source_kind, instance_id, native_id, n, NOT lost AS has_document, CASE WHEN NOT lost THEN title END AS title, CASE WHEN NOT lost THEN workspace END AS workspace,
    CASE WHEN NOT lost THEN created_at END AS created_at, CASE WHEN NOT lost THEN updated_at END AS updated_at,
    CASE WHEN NOT lost THEN coalesce(updated_at, created_at) END AS activity, failed,
    CASE WHEN lost THEN 'unindexed' WHEN failed THEN 'stale' ELSE 'current' END AS freshness,
    CASE WHEN uncovered THEN 'unknown' WHEN absent THEN 'missing' ELSE 'present' END AS source_state,
    CASE WHEN uncovered THEN '2024-05-01T00:00:00.000Z' ELSE {_day('n + 2')} END AS observed_at,
    CASE WHEN NOT lost THEN {_day('n + 1')} END AS captured_at, CASE WHEN NOT lost THEN '1' END AS adapter_version,
    CASE WHEN NOT lost THEN sha256('d' || native_id) END AS document_digest, uncovered,
    CASE WHEN NOT lost THEN CASE WHEN source_kind = 'event' AND n % 10 = 7 THEN 'unknown' ELSE 'complete' END END AS lineage_coverage
  FROM (SELECT *, source_kind = 'document' AND n % 7 = 0 AS failed, source_kind = 'document' AND n % 10 = 3 AS absent,
    source_kind = 'document' AND coalesce(nullif(regexp_extract(instance_id, '(\\d+)$', 1), '')::INT, 0) % 2 = 1 AS uncovered FROM heads)),
entry AS (
  SELECT 'conversation' AS source_kind, 'testdata' AS instance_id, conv_id::VARCHAR AS native_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, 'message' AS entry_kind,
    CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'model' WHEN 'system' THEN 'system' ELSE 'unknown' END AS actor, NULL::VARCHAR AS timestamp, text, NULL::VARCHAR AS tool_name, NULL::BIGINT AS related FROM conversations
  UNION ALL SELECT 'document', source, doc_id::VARCHAR, 0, 'message', 'unknown', NULL, text, NULL, NULL FROM documents
  UNION ALL SELECT 'event', 'testdata', user_id::VARCHAR, o, CASE o % 4 WHEN 1 THEN 'tool-call' WHEN 3 THEN 'tool-result' ELSE event_type END,
    CASE o % 4 WHEN 1 THEN 'model' WHEN 3 THEN 'tool' ELSE 'system' END, {_STAMP.format(t='ts')}, concat_ws(' ', event_type, props), CASE WHEN o % 4 = 1 THEN event_type END,
    CASE WHEN o % 4 = 3 THEN CASE WHEN user_id % 10 = 0 THEN 1 ELSE o - 2 END END
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o FROM events)),
parted AS (SELECT *, source_kind = 'conversation' AND strpos(text, ' ') > 0 AS two, source_kind = 'conversation' AND ordinal % 3 = 2 AS has_omitted FROM entry),
segment AS (
  SELECT source_kind, instance_id, native_id, ordinal, actor, 0 AS s, CASE WHEN two THEN left(text, strpos(text, ' ') - 1) ELSE text END AS body FROM parted WHERE text IS NOT NULL
  UNION ALL SELECT source_kind, instance_id, native_id, ordinal, actor, 1, substr(text, strpos(text, ' ') + 1) FROM parted WHERE two
  UNION ALL SELECT source_kind, instance_id, native_id, ordinal, actor, (text IS NOT NULL)::INT + coalesce(two, false)::INT, NULL FROM parted WHERE has_omitted),
content AS (SELECT DISTINCT sha256(body) AS digest, body AS text FROM segment WHERE body IS NOT NULL),
edge AS (
  SELECT native_id, CASE WHEN n % 40 = 39 THEN '9999' WHEN n % 50 = 48 THEN (n + 1)::VARCHAR WHEN n % 50 = 49 THEN (n - 1)::VARCHAR ELSE (n // 2)::VARCHAR END AS target, n % 25 = 0 AS low
    FROM heads WHERE source_kind = 'event' AND n > 1 AND n % 17 <> 0
  UNION ALL SELECT native_id, (n // 3)::VARCHAR, n % 25 = 0 FROM heads WHERE source_kind = 'event' AND n > 6 AND n % 12 = 6 AND n % 17 <> 0)
"""
_ID = "source_kind, instance_id, native_id"
_KEY = f"{_ID}, ordinal"
_WITH = f"WITH {_BASE}"
_RECURSIVE = f"WITH RECURSIVE {_BASE}"
_SUMMARY = f"{_ID}, title, workspace, created_at, updated_at, freshness, source_state, captured_at, observed_at, adapter_version, document_digest, activity"

_ROOTS = """
node AS (
  SELECT native_id, lineage_coverage <> 'complete' OR native_id IN (SELECT native_id FROM edge WHERE low) AS bad, native_id NOT IN (SELECT native_id FROM edge) AS top FROM spine WHERE source_kind = 'event'),
reach(native_id, spot) AS (SELECT native_id, target FROM edge UNION SELECT r.native_id, e.target FROM reach r JOIN edge e ON r.spot = e.native_id),
above AS (SELECT native_id, native_id AS spot FROM node UNION ALL SELECT * FROM reach),
event_root AS (
  SELECT a.native_id, CASE WHEN bool_and(n.native_id IS NOT NULL AND NOT n.bad) AND NOT bool_or(a.spot IN (SELECT native_id FROM reach WHERE native_id = spot)) AND count(DISTINCT a.spot) FILTER (WHERE n.top) = 1
    THEN max(a.spot) FILTER (WHERE n.top) END AS root_native_id FROM above a LEFT JOIN node n ON a.spot = n.native_id GROUP BY a.native_id),
root AS (
  SELECT source_kind, instance_id, s.native_id, CASE WHEN source_kind = 'event' THEN r.root_native_id ELSE s.native_id END AS root_native_id
  FROM spine s LEFT JOIN event_root r ON s.source_kind = 'event' AND s.native_id = r.native_id WHERE has_document)
"""
_METRICS = """(SELECT * FROM
  (SELECT source_kind, instance_id, native_id, count(*) AS entry_count FROM entry GROUP BY ALL) LEFT JOIN
  (SELECT source_kind, instance_id, native_id, count(*) AS segment_count, count(*) - count(body) AS omitted_count, coalesce(sum(strlen(body)), 0)::BIGINT AS text_bytes FROM segment GROUP BY ALL) USING (source_kind, instance_id, native_id) LEFT JOIN
  (SELECT 'event' AS source_kind, 'testdata' AS instance_id, native_id, count(*) AS relation_count FROM edge GROUP BY ALL) USING (source_kind, instance_id, native_id))"""
_COUNTS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("relation_count", "entry_count", "segment_count", "omitted_count", "text_bytes"))


def _cut(text: str, most: str) -> str:
    """The UTF-8 bytes of the longest prefix of whole code points within `most`, which is 300 at most."""
    return f"list_max(list_filter(list_transform(range(0, 301), lambda k: strlen(left({text}, k))), lambda b: b <= {most}))"


_WORD = "[\\p{L}\\p{N}]+"


def _tokens(text: str = "text") -> str:
    return f"regexp_extract_all(lower(strip_accents({text})), '{_WORD}')"


def _tf(phrase: list[str]) -> str:
    test = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len(t) + 1), lambda i: {test}))"


def _search(phrases: list[list[str]], mode: str) -> str:
    """match(digest, score, tf_i) over content."""
    tf = ", ".join(f"{_tf(p)} AS tf_{i}" for i, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (WHERE tf_{i} > 0) AS n_{i}" for i in range(len(phrases)))
    term = (
        "(CASE WHEN ln((total - n_{i} + 0.5) / (n_{i} + 0.5)) > 0 THEN ln((total - n_{i} + 0.5) / (n_{i} + 0.5)) ELSE 1e-6 END"
        " * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / mean)))"
    )
    score = " + ".join(term.replace("{i}", str(i)) for i in range(len(phrases)))
    where = (" AND " if mode == "all" else " OR ").join(f"tf_{i} > 0" for i in range(len(phrases)))
    shown = ", ".join(f"tf_{i}" for i in range(len(phrases)))
    return f"""
tok AS (SELECT digest, {_tokens()} AS t FROM content),
counted AS (SELECT digest, len(t) AS length, {tf} FROM tok),
stat AS (SELECT count(*) AS total, avg(length) AS mean, {n} FROM counted),
match AS (SELECT digest, -({score}) AS score, {shown} FROM counted, stat WHERE {where})
"""


_ALL = _search([["the"], ["and"]], "all")
_ANY = _search([["pour"], ["when"]], "any")
_ANY_COMMON = _search([["the"], ["and"]], "any")
_PHRASE = _search([["click", "k"], ["the"]], "any")
_SECOND = """
cand AS (
  SELECT source_kind, instance_id, native_id, CASE WHEN n % 3 = 0 THEN 'other' ELSE 'same' END AS digest FROM spine WHERE source_kind = 'event' AND n % 9 <> 0
  UNION ALL SELECT 'event', 'testdata', 'new-' || i, 'new' FROM range(50) t(i))
"""


#: Queries over the stored library give what those over the flat tables do.
_STORED = {"stored_topk": "search_topk", "stored_phrase": "search_phrase", "stored_support": "search_support", "stored_manifest": "manifest", "clustered_documents": "document_metrics"}


def oracle_sql() -> dict[str, str]:
    sql = _flat_sql()
    return sql | {name: sql[flat] for name, flat in _STORED.items()}


def _flat_sql() -> dict[str, str]:
    return {
        "list_conversations": f"{_WITH} SELECT {_SUMMARY} FROM spine WHERE has_document",
        "list_by_workspace_state": f"{_WITH} SELECT {_ID}, activity, source_state FROM spine WHERE has_document AND workspace = 'en' AND source_state = 'present'",
        "list_activity_bounds": f"{_WITH} SELECT {_ID}, activity, captured_at FROM spine WHERE has_document AND activity > '2024-04-05T00:00:00.000Z'"
        " AND activity < '2024-04-20T00:00:00.000Z' AND captured_at > '2024-04-02T00:00:00.000Z'",
        "list_keyset_page": f"{_WITH} SELECT {_ID}, activity FROM spine WHERE has_document AND source_kind = 'document' AND (activity IS NULL OR activity < '2024-04-20T00:00:00.000Z'"
        f" OR (activity = '2024-04-20T00:00:00.000Z' AND ({_ID}) > ('document', 'src5', '5'))) ORDER BY activity DESC NULLS LAST, {_ID} LIMIT 51",
        "capture_scope": f"""{_WITH}, c AS (
  SELECT count(*) AS tracked, count(*) FILTER (WHERE has_document) AS retained, count(*) FILTER (WHERE freshness = 'current') AS current, count(*) FILTER (WHERE freshness = 'stale') AS stale,
    count(*) FILTER (WHERE freshness = 'unindexed') AS unindexed, count(*) FILTER (WHERE source_state = 'present') AS source_present,
    count(*) FILTER (WHERE source_state = 'missing') AS source_missing, count(*) FILTER (WHERE source_state = 'unknown') AS source_unknown,
    0 AS failed_unavailable, count(*) FILTER (WHERE failed) AS failed_unreadable, 0 AS failed_malformed, 0 AS failed_source_changed, 0 AS failed_unsupported_format, 0 AS failed_repository_write
  FROM spine WHERE source_kind = 'document'),
s AS (SELECT count(*) AS source_instances, count(*) FILTER (WHERE NOT uncovered) AS complete_sources, count(*) FILTER (WHERE uncovered) AS unknown_sources
  FROM (SELECT DISTINCT source_kind, instance_id, uncovered FROM spine WHERE source_kind = 'document'))
SELECT *, CASE WHEN source_instances >= 1 AND unknown_sources = 0 AND stale = 0 AND unindexed = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM c, s""",
        "coverage_counts": f"{_WITH} SELECT count(*) AS source_instances, count(*) FILTER (WHERE NOT uncovered) AS complete_sources, count(*) FILTER (WHERE uncovered) AS unknown_sources"
        " FROM (SELECT DISTINCT source_kind, instance_id, uncovered FROM spine)",
        "freshness": f"{_WITH} SELECT {_ID}, freshness, source_state, observed_at, adapter_version FROM spine",
        "document_metrics": f"""{_WITH} SELECT {_ID}, {_COUNTS} FROM spine LEFT JOIN {_METRICS} USING ({_ID}) WHERE has_document""",
        "manifest": f"""{_RECURSIVE}, {_ROOTS} SELECT {_ID}, document_digest, created_at, updated_at, captured_at, observed_at, source_state, freshness, adapter_version, lineage_coverage, root_native_id, {_COUNTS}
  FROM spine JOIN root USING ({_ID}) LEFT JOIN {_METRICS} USING ({_ID}) WHERE has_document""",
        "entries_all": f"{_WITH} SELECT {_KEY}, entry_kind, tool_name, timestamp FROM entry WHERE source_kind = 'event' AND actor = 'model' AND tool_name = 'click' AND entry_kind = 'tool-call'",
        "entries_first": f"{_WITH} SELECT {_KEY}, timestamp FROM entry WHERE entry_kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY ordinal) = 1",
        "entries_last": f"{_WITH} SELECT {_KEY}, timestamp FROM entry WHERE timestamp > '2024-01-01T12:00:00.000Z' QUALIFY row_number() OVER (PARTITION BY {_ID} ORDER BY ordinal DESC) = 1",
        "entries_origin": f"{_WITH} SELECT DISTINCT {_KEY}, actor FROM segment WHERE actor = 'human'",
        "entry_counts": f"{_WITH} SELECT {_KEY}, coalesce(t, 0) AS text_segments, coalesce(o, 0) AS omitted_segments FROM entry LEFT JOIN (SELECT {_KEY}, count(body) AS t, count(*) - count(body) AS o FROM segment GROUP BY ALL) USING ({_KEY})",
        "entry_preview": f"""{_WITH}, first AS (SELECT {_KEY}, arg_min(body, s) AS text FROM segment WHERE body IS NOT NULL GROUP BY ALL)
SELECT {_KEY}, CASE WHEN strlen(f.text) <= 64 THEN f.text ELSE
  list_max(list_transform(list_filter(range(1, 65), lambda k: strlen(left(f.text, k)) <= 64), lambda k: struct_pack(k := k, s := left(f.text, k)))).s END AS preview,
  strlen(f.text) > 64 AS preview_truncated FROM entry LEFT JOIN first f USING ({_KEY})""",
        "entry_bodies": f"{_WITH}, b AS (SELECT {_KEY}, string_agg(body, chr(10) ORDER BY s) AS body FROM segment WHERE body IS NOT NULL GROUP BY ALL) SELECT {_KEY}, body FROM entry LEFT JOIN b USING ({_KEY})",
        "content_intern": f"{_WITH} SELECT digest, strlen(text) AS bytes FROM content",
        "content_orphans": f"""{_WITH} SELECT count(*) AS orphan_rows, coalesce(sum(strlen(text)), 0)::BIGINT AS orphan_bytes FROM content
  WHERE text NOT IN (SELECT body FROM segment WHERE (source_kind <> 'event' OR ordinal % 2 = 0) AND body IS NOT NULL)""",
        "content_recurrence": f"{_WITH} SELECT sha256(body) AS digest, count(*) AS occurrences, count(DISTINCT ({_ID})) AS conversations FROM segment WHERE body IS NOT NULL GROUP BY body HAVING count(*) > 1",
        "search_all": f"{_WITH}, {_ALL} SELECT digest, round(score, 6) AS score FROM match",
        "search_any": f"{_WITH}, {_ANY} SELECT digest, round(score, 6) AS score FROM match",
        "search_phrase": f"{_WITH}, {_PHRASE} SELECT digest, round(score, 6) AS score FROM match",
        "search_support": f"""{_RECURSIVE}, {_ROOTS}, {_PHRASE}, m AS (SELECT e.*, digest FROM segment e JOIN match ON sha256(body) = digest)
SELECT (SELECT count(*) FROM m) AS occurrences, (SELECT count(DISTINCT digest) FROM m) AS distinct_texts, count(DISTINCT CASE WHEN root_native_id IS NOT NULL THEN
  (source_kind, CASE WHEN source_kind = 'event' THEN 'testdata' ELSE instance_id END, root_native_id) END) AS known_roots, count(*) FILTER (WHERE root_native_id IS NULL) AS unknown_lineage
FROM (SELECT DISTINCT {_ID} FROM m) JOIN root USING ({_ID})""",
        "search_matched_terms": f"""{_WITH}, {_ANY} SELECT {_KEY}, concat_ws(' ', CASE WHEN bool_or(tf_0 > 0) THEN 'pour' END, CASE WHEN bool_or(tf_1 > 0) THEN 'when' END) AS matched_terms
FROM segment JOIN match ON sha256(body) = digest GROUP BY {_KEY}""",
        "search_best_segment": f"""{_WITH}, {_ANY_COMMON} SELECT {_KEY}, s AS segment_ordinal, n - 1 AS additional_segments, round(score, 6) AS score
FROM (SELECT {_KEY}, s, score, count(*) OVER w AS n, row_number() OVER (PARTITION BY {_KEY} ORDER BY score, s) AS place FROM segment JOIN match ON sha256(body) = digest WINDOW w AS (PARTITION BY {_KEY})) WHERE place = 1""",
        "search_origin": f"{_WITH}, {_ANY_COMMON} SELECT {_KEY}, s AS segment_ordinal, digest FROM segment JOIN match ON sha256(body) = digest WHERE actor = 'human'",
        "search_topk": f"""{_WITH}, {_ALL} SELECT {_KEY}, round(score, 6) AS score FROM segment JOIN match ON sha256(body) = digest JOIN spine USING ({_ID}) WHERE source_kind = 'document'
ORDER BY match.score, activity DESC NULLS LAST, {_KEY} LIMIT 21""",
        "search_excerpts": f"""{_WITH}, tok AS (SELECT digest, text, regexp_extract_all(text, '{_WORD}') AS raw, regexp_split_to_array(text, '{_WORD}') AS gap FROM content),
w AS (SELECT digest, len(raw) AS many, unnest(raw) AS r, unnest(gap[:len(raw)]) AS g, unnest(range(len(raw))) AS place FROM tok),
x AS (SELECT *, lower(strip_accents(r)) AS t, sum(length(r) + length(g)) OVER (PARTITION BY digest ORDER BY place) AS high, place = 0 OR regexp_matches(g, '[.:][ \\t\\n\\r]+$') AS opens FROM w),
h AS (SELECT *, high - length(r) AS low, coalesce(t = 'click' AND lead(t) OVER (PARTITION BY digest ORDER BY place) = 'k', false) AS a, t = 'the' AS b FROM x),
y AS (SELECT *, max(a::INT) OVER f + max(b::INT) OVER f AS kinds, sum(a::INT + b::INT) OVER f AS n, max(CASE WHEN a THEN place + 2 WHEN b THEN place + 1 END) OVER f AS last,
  min(CASE WHEN a OR b THEN place END) OVER l AS hit, min(CASE WHEN opens THEN place END) OVER l AS opening FROM h
  WINDOW f AS (PARTITION BY digest ORDER BY place ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING), l AS (PARTITION BY digest ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT digest, many, 999 * kinds + n AS score, place AS asked, 0 AS kind, greatest(0, least(many - 64, place - (64 - (last - place)) // 2)) AS first FROM y WHERE a OR b
  UNION ALL SELECT digest, many, 999 * kinds + n + CASE place WHEN 0 THEN 120 ELSE 100 END, hit, 1, place FROM y WHERE many > 64 AND opens AND hit < coalesce(opening, many)),
best AS (SELECT digest, first FROM c QUALIFY row_number() OVER (PARTITION BY digest ORDER BY score DESC, asked, kind) = 1),
span AS (SELECT digest, many, first, CASE first WHEN 0 THEN 0 ELSE min(low) FILTER (WHERE place = first) END AS low, max(high) FILTER (WHERE place = first + 63) AS high, min(low) FILTER (WHERE place >= first AND (a OR b)) AS hit
  FROM h JOIN best USING (digest) GROUP BY digest, many, first),
e AS (SELECT digest, text, CASE WHEN first > 0 THEN ' … ' ELSE '' END || text[(low + 1)::BIGINT:CASE WHEN first + 64 < many THEN high ELSE length(text) END::BIGINT] || CASE WHEN first + 64 < many THEN ' … ' ELSE '' END AS excerpt,
  (hit - low + CASE WHEN first > 0 THEN 3 ELSE 0 END)::BIGINT AS anchor FROM span JOIN content USING (digest)),
p AS (SELECT *, right(left(excerpt, anchor), list_max(list_filter(range(0, 129), lambda k: strlen(right(left(excerpt, anchor), k)) <= 128))) AS before, excerpt[anchor + 1:] AS rest FROM e),
q AS (SELECT *, CASE WHEN strlen(excerpt) <= 512 THEN excerpt ELSE before || left(rest, list_max(list_filter(range(0, 513), lambda k: strlen(left(rest, k)) <= 512 - strlen(before)))) END AS snippet FROM p)
SELECT digest, excerpt, snippet, snippet <> text AS snippet_truncated FROM q""",
        "context_adjacent": f"""{_WITH} SELECT a.source_kind, a.instance_id, a.native_id, a.ordinal, b.ordinal AS context_ordinal FROM entry a JOIN entry b
  ON a.source_kind = b.source_kind AND a.instance_id = b.instance_id AND a.native_id = b.native_id AND abs(a.ordinal - b.ordinal) BETWEEN 1 AND 2 WHERE a.source_kind = 'event' AND a.entry_kind = 'signup'""",
        "context_linked": f"""{_WITH}, one AS (SELECT native_id, ordinal AS a, related AS b FROM entry WHERE entry_kind = 'tool-result'), pair AS (SELECT * FROM one UNION SELECT native_id, b, a FROM one),
ranked AS (SELECT *, row_number() OVER (PARTITION BY native_id, a ORDER BY b) AS place, count(*) OVER (PARTITION BY native_id, a) AS n FROM pair WHERE abs(a - b) > 1)
SELECT 'event' AS source_kind, 'testdata' AS instance_id, native_id, a AS ordinal, b AS partner, n > 5 AS linked_truncated FROM ranked WHERE place <= 5""",
        "context_bodies": f"""{_WITH} SELECT {_KEY}, left(string_agg(body, chr(10) ORDER BY s), 40) AS body FROM segment WHERE source_kind = 'event' AND body IS NOT NULL GROUP BY ALL""",
        "entries_keyset_page": f"{_WITH} SELECT {_KEY}, entry_kind FROM entry WHERE source_kind = 'event' AND ({_ID}, ordinal) > ('event', 'testdata', '12', 7) ORDER BY {_KEY} LIMIT 41",
        "canonical_timestamps": f"""{_WITH}, t AS (SELECT {_KEY}, timestamp AS good, replace(timestamp, 'Z', '+00:00') AS zone, left(timestamp, 19) || 'Z' AS short, overlay AS broken
  FROM (SELECT *, left(timestamp, 5) || '13' || substr(timestamp, 8) AS overlay FROM entry WHERE source_kind = 'event')),
c AS (SELECT {_KEY}, unnest([good, zone, short, broken]) AS stamp, unnest(['good', 'zone', 'short', 'broken']) AS form FROM t)
SELECT {_KEY}, form, regexp_full_match(stamp, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{{3}}Z') AND try_strptime(stamp, '%Y-%m-%dT%H:%M:%S.%gZ') IS NOT NULL AS canonical FROM c""",
        "segment_metadata": f"{_WITH} SELECT {_KEY}, s AS segment_ordinal, 'entry' AS name, ordinal::VARCHAR AS value FROM segment WHERE body IS NULL",
        "foreign_keys": f"""{_WITH}, kept AS (SELECT * FROM spine WHERE has_document AND NOT (source_kind = 'event' AND n % 8 = 1))
SELECT 'entries' AS "table", count(*) AS rows FROM entry ANTI JOIN kept USING ({_ID}) UNION ALL SELECT 'relations', count(*) FROM edge WHERE native_id NOT IN (SELECT native_id FROM kept WHERE source_kind = 'event')
UNION ALL SELECT 'contents', count(*) FROM segment WHERE body IS NOT NULL AND sha256(body) < '1'""",
        "vocabulary_diff": f"""{_WITH}, term AS (SELECT digest, unnest({_tokens()}) AS term FROM content),
v AS (SELECT term, count(DISTINCT digest) AS left_texts, count(*) AS left_instances, count(DISTINCT digest) FILTER (WHERE digest < '8') AS right_texts, count(*) FILTER (WHERE digest < '8') AS right_instances FROM term GROUP BY term)
SELECT term, left_texts, left_instances, nullif(right_texts, 0) AS right_texts, nullif(right_instances, 0) AS right_instances FROM v WHERE left_instances <> right_instances""",
        "run_report": f"""{_WITH} SELECT entry_kind AS instance_id, native_id::BIGINT * 1000000 + ordinal AS run_id, entry_kind <> 'view' AS complete FROM entry WHERE source_kind = 'event'
QUALIFY row_number() OVER (PARTITION BY entry_kind ORDER BY native_id::BIGINT * 1000000 + ordinal DESC) = 1""",
        "lineage_roots": f"{_RECURSIVE}, {_ROOTS} SELECT {_ID}, root_native_id FROM root",
        "lineage_support": f"""{_RECURSIVE}, {_ROOTS} SELECT count(DISTINCT CASE WHEN root_native_id IS NOT NULL THEN (source_kind, instance_id, root_native_id) END) AS known_roots,
  count(*) FILTER (WHERE root_native_id IS NULL) AS unknown_lineage FROM root""",
        "changed_detect": f"{_WITH}, {_SECOND} SELECT {_ID}, CASE digest WHEN 'same' THEN 'unchanged' WHEN 'other' THEN 'changed' ELSE 'new' END AS status FROM cand",
        "missing_reconcile": f"{_WITH}, {_SECOND} SELECT {_ID} FROM spine WHERE source_kind = 'event' EXCEPT SELECT {_ID} FROM cand",
        "run_retention": f"""{_WITH} SELECT native_id::BIGINT * 1000000 + ordinal AS run_id, entry_kind AS instance_id, timestamp AS finished_at FROM entry WHERE source_kind = 'event'
QUALIFY row_number() OVER (PARTITION BY entry_kind ORDER BY timestamp DESC, native_id::BIGINT * 1000000 + ordinal DESC) <= 20""",
        "projection_diff": f"""{_WITH}, term AS (SELECT digest, unnest({_tokens()}) AS term FROM content)
SELECT CASE WHEN digest < '1' THEN 'left' ELSE 'right' END AS side, digest, count(*) AS n FROM term WHERE digest < '1' OR digest >= '9' GROUP BY ALL""",
        "adjacent_collapse": f"""{_WITH}, e AS (SELECT {_KEY}, split_part(text, ' ', 1) AS segments FROM entry WHERE source_kind = 'event'),
r AS (SELECT *, ordinal - row_number() OVER (PARTITION BY {_ID}, segments ORDER BY ordinal) AS run FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY {_ID}, segments, run ORDER BY ordinal) AS place, count(*) OVER (PARTITION BY {_ID}, segments, run) AS size FROM r),
q AS (SELECT *, (ordinal - place + 1) % 2 = 0 AS event_first FROM p)
SELECT {_KEY}, CASE WHEN event_first AND size = 1 THEN 'event' ELSE 'response' END AS family, segments FROM q
WHERE place = 1 OR (NOT event_first AND place % 2 = 1) OR (event_first AND place >= 4 AND place % 2 = 0)""",
        "tool_link": f"""{_WITH}, twice AS (SELECT native_id FROM entry WHERE entry_kind = 'tool-result' GROUP BY native_id, related HAVING count(*) > 1)
SELECT {_ID}, 'call-' || related AS tool_call_id, related AS call_ordinal, ordinal AS result_ordinal, native_id IN (SELECT native_id FROM twice) AS malformed FROM entry WHERE entry_kind = 'tool-result'""",
        "transcript_window": f"{_WITH} SELECT {_KEY}, entry_kind FROM entry WHERE ordinal BETWEEN 5 AND 14",
        "transcript_budget": f"""{_RECURSIVE}, t AS (
  SELECT {_ID}, ordinal, s, body, row_number() OVER (PARTITION BY {_ID} ORDER BY ordinal, s) AS place FROM segment QUALIFY place <= 100),
shown AS (
  SELECT {_ID}, place, {_cut("coalesce(body, '')", '300')} AS emitted, 1000 - {_cut("coalesce(body, '')", '300')} AS rest FROM t WHERE place = 1
  UNION ALL SELECT t.source_kind, t.instance_id, t.native_id, t.place, {_cut("coalesce(body, '')", 'least(300, rest)')}, rest - {_cut("coalesce(body, '')", 'least(300, rest)')}
    FROM shown JOIN t ON t.source_kind = shown.source_kind AND t.instance_id = shown.instance_id AND t.native_id = shown.native_id AND t.place = shown.place + 1)
SELECT {_ID}, ordinal, s AS segment_ordinal, emitted, coalesce(emitted < strlen(body), false) AS truncated FROM shown JOIN t USING ({_ID}, place)""",
        "stored_proofs": f"{_WITH} SELECT {_ID}, ordinal // 256 AS block, count(*) AS entry_count, true AS proven FROM entry GROUP BY ALL",
        "sha256_text": f"{_WITH} SELECT digest, sha256(text) AS again FROM content",
        "identity_codec": f"{_WITH} SELECT source_kind || '@' || instance_id || '%20%C3%BC%2F%2A~:' || native_id AS printable, instance_id || ' ü/*~' AS instance, native_id AS native FROM spine",
        "metadata_filters": f"{_WITH} SELECT {_ID}, observed_at FROM spine WHERE has_document AND source_kind = 'document' AND instance_id = 'src2' AND observed_at > '2024-04-10T00:00:00.000Z'",
    }
