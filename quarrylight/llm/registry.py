"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import language, toxicity
from quarrylight.llm.alignment import align_documents
from quarrylight.llm.common import read
from quarrylight.llm.decontaminate import contaminated
from quarrylight.llm.licenses import scan_licenses
from quarrylight.llm.minhash import near_duplicates
from quarrylight.llm.packing import pack_documents
from quarrylight.llm.repair import repair_conversations
from quarrylight.llm.secrets import scan_secrets
from quarrylight.llm.sharding import shard_documents
from quarrylight.llm.substrings import remove_repeats
from quarrylight.llm.tokenfile import token_file_digest
from quarrylight.llm.topk import top_k


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(read(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_longest_first_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=16)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(read(spark, sf_dir, "conversations"))


#: A document's distinct three-word shingles, links by shared shingles, then the smallest id that links reach.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN sizes USING (doc_id)
"""

#: Distinct five-word shingles of documents and items, counted where they meet.
DECONTAMINATION_SQL = r"""
WITH words AS (
  SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark)),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'item' GROUP BY id),
common AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'doc' AND i.kind = 'item' GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, c AS n_shared, c / n AS containment
FROM common JOIN sizes ON sizes.id = item_id WHERE 100 * c >= 80 * n
"""

TOP_K_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: CRC-32 by its table, faults by windows, then the cheapest (cost, audit) of each state row after row; the audit deals the roles.
CONVERSATION_REPAIR_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_concat([4294967295],
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS deal
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
    CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, range(CASE deal WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
  FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM numbered),
counts AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
inserts(state, letters, after) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)),
reads(state, role, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edits AS (
  SELECT conv_id, n, s.state, 'D' AS letter, 2 AS cost, s.state AS after FROM faults, range(4) s(state)
  UNION ALL SELECT conv_id, n, r.state, CASE WHEN initial = r.role THEN 'K' ELSE 'R' END, (CASE WHEN initial = r.role THEN 0 ELSE 1 END) + (CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END), r.after
  FROM faults, reads r WHERE fault IN ('none', 'truncated') AND (initial = r.role OR r.role <> 's')),
steps AS (
  SELECT e.conv_id, e.n, i.state, i.letters || e.letter AS letters, 5 * length(i.letters) + e.cost AS cost, e.after FROM inserts i JOIN edits e ON e.state = i.after),
best(conv_id, n, state, found) AS (
  SELECT conv_id, 0, 0, {'cost': 0, 'audit': ''} FROM counts
  UNION ALL
  SELECT s.conv_id, s.n, s.after, min({'cost': b.found.cost + s.cost, 'audit': b.found.audit || s.letters})
  FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.n + 1 AND s.state = b.state GROUP BY s.conv_id, s.n, s.after),
audits AS (
  SELECT b.conv_id, min({'cost': found.cost + 5 * length(letters), 'audit': found.audit || letters}) AS found
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n_rows = b.n JOIN inserts i ON i.state = b.state AND i.after IN (0, 3) GROUP BY b.conv_id),
letters AS (SELECT conv_id, unnest(string_split(found.audit, '')) AS letter, unnest(range(1, length(found.audit) + 1)) AS k FROM audits WHERE found.audit <> ''),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS n, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS place FROM letters),
kept AS (
  SELECT p.conv_id, p.k, p.place, p.letter, f.role, CASE WHEN p.letter = 'I' THEN '' ELSE f.text END AS text,
    max(CASE WHEN p.place = 1 AND p.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led
  FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n WHERE p.letter <> 'D'),
repaired AS (
  SELECT conv_id, string_agg((CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY k) AS text
  FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(found.cost, 0)::BIGINT AS cost, coalesce(found.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE = {"op13_conversation_repair": CONVERSATION_REPAIR_SQL, "op3_top_k": TOP_K_SQL, "op6_decontamination": DECONTAMINATION_SQL, "op9_near_duplicates": NEAR_DUPLICATES_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_repeated_strings, op2_token_files, op3_top_k, op4_toxicity, op5_longest_first_shards, op6_decontamination, op7_language, op8_secret_scan, op9_near_duplicates, op10_best_two_fit, op11_license_scan, op12_token_alignment, op13_conversation_repair)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
