"""The operators of this subpackage as queries over the tables of a data folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import bpe, decontaminate, digest_index, embed_dup, licenses, line_dedup, merkle, near_dup, quality, quotes, replay, ring, store, token_records
from threadlake.llm.store import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embed_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), copies_from=line_dedup.NOT_BLANK)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as binary records, reads the files back and places each document among all ids."""
    to = store.fresh_path(spark, "op5")
    token_records.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), to)
    return token_records.placed(spark, to).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op6_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.assign(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lets all documents into a new digest index, in two batches."""
    return digest_index.deduplicated(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_near_dup": op2_near_dup,
        "op3_embed_dup": op3_embed_dup,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_records": op5_token_records,
        "op6_ring": op6_ring,
        "op7_quotes": op7_quotes,
        "op8_bpe": op8_bpe,
        "op9_licenses": op9_licenses,
        "op10_quality": op10_quality,
        "pipeline": corpus_pipeline.run,
        "op11_replay": op11_replay,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_merkle": op13_merkle,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split_regex({_LOWER.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS padded FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, row_number() OVER () AS k, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (
  SELECT item_id, k, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END)) AS shingle
  FROM i WHERE len(w) > 0),
f AS (
  SELECT doc_id, item_id, k, count(*) AS n_item, count(*) FILTER (WHERE contains(padded, ' ' || shingle || ' ')) AS n_found
  FROM d CROSS JOIN s GROUP BY doc_id, item_id, k)
SELECT DISTINCT doc_id, item_id, n_item, n_found, n_found / n_item AS containment
FROM f WHERE n_found >= 0.75 * n_item
"""

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS shingle
  FROM w WHERE w IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id
  WHERE list_inner_product(x.v, y.v) >= 0.95 * sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.other = link.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""


# The table of crc32 by its rule, and the crc32 of a text's UTF-8 bytes by that table (t.crc).
_CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: x::UBIGINT)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range((length(hex(encode({0}))) // 2)::BIGINT), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::UBIGINT)),
  lambda c, b: xor(c >> 8, t.crc[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT"""


def _h(k: int) -> str:
    return _CRC.format(f"('{k}:' || conv_id || ':' || turn)")


OP11_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED {_CRC_TABLE},
e AS MATERIALIZED (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, {_CRC.format("coalesce(text, '')")} AS crc,
    {_h(0)} % 3 AS back, {_h(1)} % 101 < 35 AS faulty, {_h(2)} % 101 AS repair, [{", ".join(f"{_h(a + 2)} % 3 = 0" for a in range(1, 6))}] AS fails
  FROM conversations, t),
-- up1 and up2: when the turn one and two before was delivered; -1 where it wasn't.
tried AS (
  SELECT conv_id, p, -1::BIGINT AS start, 0 AS attempts, -1::BIGINT AS up1, -1::BIGINT AS up2 FROM (SELECT DISTINCT conv_id, -1 AS p FROM e)
  UNION ALL
  SELECT conv_id, p, start, attempts, CASE WHEN attempts BETWEEN 1 AND 5 THEN start + 10 * (2 ** (attempts - 1) - 1)::BIGINT ELSE -1 END, up2
  FROM (
    SELECT conv_id, p, start, up2, CASE WHEN start < 0 THEN 0 WHEN NOT faulty THEN 1
      ELSE coalesce(list_min(list_filter(range(1, 6), lambda a: start + 10 * (2 ** (a - 1) - 1)::BIGINT >= 7 * p + repair AND NOT fails[a])), 6) END AS attempts
    FROM (
      SELECT e.conv_id, e.p, e.faulty, e.repair, e.fails, r.up1 AS up2,
        CASE WHEN back = 0 OR back > e.p THEN 7 * e.p WHEN back = 1 AND r.up1 >= 0 THEN greatest(7 * e.p, r.up1) WHEN back = 2 AND r.up2 >= 0 THEN greatest(7 * e.p, r.up2) ELSE -1 END AS start
      FROM tried r JOIN e ON e.conv_id = r.conv_id AND e.p = r.p + 1))),
fate AS (
  SELECT e.conv_id, e.turn, e.p, e.crc, CASE attempts WHEN 0 THEN 'blocked' WHEN 6 THEN 'dead' ELSE 'delivered' END AS status, least(attempts, 5)::INTEGER AS attempts,
    CASE WHEN attempts > 0 THEN start END AS first_at, CASE WHEN attempts > 0 THEN start + 10 * (2 ** (least(attempts, 5) - 1) - 1)::BIGINT END AS last_at
  FROM tried r JOIN e ON e.conv_id = r.conv_id AND e.p = r.p),
released AS (SELECT conv_id, p, crc, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, p) AS release_no FROM fate WHERE status = 'delivered'),
state AS (SELECT conv_id, p, release_no, (sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no))::BIGINT AS state FROM released)
SELECT f.conv_id, f.turn, f.p, status, attempts, first_at, last_at, release_no, state FROM fate f LEFT JOIN state s ON s.conv_id = f.conv_id AND s.p = f.p
"""

OP12_SQL = f"""
WITH h AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""


def _fields(text: str) -> str:
    field = lambda v: f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')"
    return " || ".join(field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))


OP13_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED {_CRC_TABLE},
d AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree, sha256({_fields("text")}) AS leaf,
    CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_fields(_LOWER.format("text"))}) ELSE sha256({_fields("text")}) END AS altered
  FROM documents, t),
leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
low AS (
  SELECT tree, 0 AS level, i, n, leaf AS digest FROM leaf
  UNION ALL
  SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 8, n),
sub AS (SELECT tree, level AS height, digest AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS i, (SELECT count(*) FROM sub) AS n, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 8, n),
node AS MATERIALIZED (SELECT tree, level, i, digest FROM low WHERE n > 1 UNION ALL SELECT -1, level, i, digest FROM high WHERE n > 1),
run AS MATERIALIZED (SELECT tree, level, i // 8 AS up, list(digest ORDER BY i) AS run FROM node GROUP BY tree, level, i // 8),
-- Every row's steps to the root: the run that it meets and its place in it.
step AS (
  SELECT doc_id, leaf, 0 AS nth, l.tree, 0 AS level, i, height, l.tree AS own FROM leaf l JOIN sub ON sub.tree = l.tree
  UNION ALL
  SELECT doc_id, leaf, nth + 1, CASE WHEN tree >= 0 AND level = height THEN -1 ELSE tree END,
    CASE WHEN tree >= 0 AND level = height THEN 0 ELSE level + 1 END, CASE WHEN tree >= 0 AND level = height THEN own ELSE i // 8 END, height, own
  FROM step WHERE NOT (tree = -1 AND level >= (SELECT max(level) FROM high))),
met AS MATERIALIZED (
  SELECT doc_id, leaf, nth, array_to_string(run[:i % 8], '') AS before, array_to_string(run[i % 8 + 2:], '') AS after
  FROM step s JOIN run r ON r.tree = s.tree AND r.level = s.level AND r.up = s.i // 8),
path AS (SELECT doc_id, leaf, list(before ORDER BY nth) AS befores, list(after ORDER BY nth) AS afters, sha256(string_agg(before || after, '' ORDER BY nth)) AS proof_sha256 FROM met GROUP BY doc_id, leaf),
fold AS (
  SELECT l.doc_id, l.leaf, 1 AS k, altered AS now, befores, afters FROM leaf l LEFT JOIN path p ON p.doc_id = l.doc_id AND p.leaf = l.leaf
  UNION ALL
  SELECT doc_id, leaf, k + 1, sha256(befores[k] || now || afters[k]), befores, afters FROM fold WHERE k <= len(befores)),
top AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, now AS folded_root, now = root AS verified
FROM leaf l JOIN sub ON sub.tree = l.tree, top
  LEFT JOIN path p ON p.doc_id = l.doc_id AND p.leaf = l.leaf
  JOIN fold f ON f.doc_id = l.doc_id AND f.leaf = l.leaf AND f.k = coalesce(len(f.befores), 0) + 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_near_dup": OP2_SQL, "op3_embed_dup": OP3_SQL, "op11_replay": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_merkle": OP13_SQL}
