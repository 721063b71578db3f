"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_WS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_WS}), '{_UPPER}', '{_LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.line, k.line_no, r.key IS NOT NULL AND r.largest <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WS}) <> '') AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS pos, words FROM d WHERE len(words) >= 5
), v AS (
  SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 4), chr(32)) AS win FROM w
), r AS (
  SELECT doc_id, pos FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), c AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, range(5) AS t(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_distinct(words)) AS n_different, len(list_filter(lines, lambda x: regexp_matches(rtrim(x, {_WS}), '(\.\.\.|…)$'))) AS n_cut_lines
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * n_letter_words < 60 * n_words OR (n_words >= 30 AND n_different < 10) OR 100 * n_cut_lines > 30 * n_lines) AS kept
FROM m
"""

OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), occ AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY lang, source, term
), cell AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p
  FROM cell JOIN v USING (lang)
), whole AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY lang, term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n::HUGEINT + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
  FROM whole JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5, "op10_quality_rules": OP10, "op11_hard_negatives": OP11, "op12_source_audit": OP12}
