"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words)
), sizes AS (
  SELECT doc_id, count(s) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n
"""

OP3 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>|\|)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS r,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|\|)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS t FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 8 + 7 + 7) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP6 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS s FROM base WHERE len(w) >= 3
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), facts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines FROM base LEFT JOIN covered USING (doc_id)
), ledger AS (
  SELECT *, CAST((n_words < 50)::INTEGER + 2 * (100 * n_repeat_words > 50 * n_words)::INTEGER + 4 * (10 * n_symbols > n_words)::INTEGER + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)::INTEGER
    + 16 * (word_chars > 14 * n_words)::INTEGER + 32 * (word_chars < 2 * n_words)::INTEGER AS INTEGER) AS failed FROM facts
)
SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 15) = 0 AS kept FROM ledger
"""

OP9 = rf"""
WITH sized AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW o AS (ORDER BY most / weight, nth)
), goals AS (
  SELECT *, least(most, coalesce((SELECT arg_min(level, (most / weight, nth)) FROM levels WHERE level * weight <= most) * weight, most)) AS target FROM levels
), seats AS (
  SELECT block, CAST(round(total / block) AS BIGINT) AS seats FROM (
    SELECT sum(target) AS total, CAST(greatest(1, floor(coalesce(min(target) FILTER (target > 0), 1) / 256), ceil(sum(target) / pow(2, 40))) AS BIGINT) AS block FROM goals)
), quotients AS (
  SELECT nth, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, nth) AS place FROM goals, (SELECT unnest(range(0, (SELECT seats FROM seats))) AS k) WHERE target > 0
), houses AS (
  SELECT s AS shard, CAST(floor(seats * s / CAST(16 AS DOUBLE)) AS BIGINT) AS house FROM seats, (SELECT unnest(range(0, 17)) AS s)
), quotas AS (
  SELECT g.nth, h.shard, count(q.nth) AS quota FROM goals g CROSS JOIN houses h LEFT JOIN quotients q ON q.nth = g.nth AND q.place <= h.house GROUP BY g.nth, h.shard
), laid AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM sized
), words AS (
  SELECT l.id, l.doc_id, l.source, l.size, g.source_size, g.target, q.shard,
    least(l.size * 2, (q.quota // b) * l.size + least(l.stop, (q.quota % b) * block) - least(l.stop - l.size, (q.quota % b) * block)) AS so_far
  FROM laid l JOIN (SELECT *, greatest(1, CAST(ceil(source_size / CAST(block AS DOUBLE)) AS BIGINT)) AS b FROM goals, seats) g ON g.source IS NOT DISTINCT FROM l.source JOIN quotas q ON q.nth = g.nth
), parts AS (
  SELECT *, so_far - lag(so_far) OVER (PARTITION BY id ORDER BY shard) AS part FROM words
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(sum(part) AS BIGINT) AS taken, string_agg(CAST(part AS VARCHAR), ',' ORDER BY shard) AS shard_taken
FROM parts WHERE shard > 0 GROUP BY id, doc_id, source, size, source_size, target
"""

EDITED = OP3.replace(
    """coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'""",
    "coalesce(text, '') || CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(role, '') DESC, coalesce(text, '') DESC) = 1 THEN '!' ELSE '' END AS text FROM conversations",
)

ABLATIONS = OP6.replace(
    "SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 15) = 0 AS kept FROM ledger",
    """SELECT rule, CAST(count(*) FILTER (failed & bit <> 0) AS BIGINT) AS failing, CAST(count(*) FILTER (failed & 15 = bit) AS BIGINT) AS only
FROM ledger, (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8)) AS r(rule, bit) GROUP BY rule""",
)

ORACLES = {"op2_minhash_near_dups": OP2, "op3_chat_format": OP3, "op6_quality_rules": OP6, "op9_source_mixing": OP9, "rules_ablations": ABLATIONS, "chat_edited_log": EDITED}
