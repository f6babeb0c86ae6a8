"""DuckDB SQL for the queries that SQL can express on whole tables.

Not here, and tested against plain versions in tests/llm instead: op1 and the pipeline
(trained), op2 (archives), op4 and op8 (components of a graph), op5 (windows of bytes),
op7 (a vocabulary file), op13 (eigenvectors).
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
NORMAL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op3_mixing"] = f"""WITH sized AS (
  SELECT doc_id, source, CAST(len({SPLIT}) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
               - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted),
chosen AS (
  SELECT *, (SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap) AS a
  FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN a IS NULL OR a * weight > cap THEN cap ELSE a * weight END AS target FROM chosen),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM targets),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - certain AS p,
         target - certain * source_size AS missing FROM parts),
drawn AS (
  SELECT s.doc_id, s.size, t.source, t.source_size, t.target, t.certain, t.p, t.missing,
         (CAST('0x' || substr(md5('mix:' || CAST(s.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM sized s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (
             PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM drawn WHERE p > 0)
SELECT doc_id, size, source_size, target,
       CAST(size * (certain + CASE WHEN ahead + size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
UNION ALL
SELECT doc_id, size, source_size, target, CAST(size * certain AS BIGINT) FROM drawn WHERE p <= 0"""

ORACLES["op6_contamination"] = f"""WITH items AS (
  SELECT item_id, {NORMAL} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + 9], ' ') AS words
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i
        FROM items WHERE len(ws) > 0) w),
texts AS (SELECT doc_id, {NORMAL} AS ws FROM documents),
places AS (
  SELECT t.doc_id, t.ws, k.k, unnest(generate_series(1, len(t.ws) - k.k + 1)) AS i
  FROM texts t, (SELECT DISTINCT k FROM windows) k WHERE len(t.ws) >= k.k),
hits AS (
  SELECT p.doc_id, p.i, p.k, w.item_id
  FROM (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS words FROM places) p
  JOIN windows w ON w.words = p.words AND w.k = p.k),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS place FROM hits) c GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) f
  GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
       coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id LEFT JOIN found f ON f.doc_id = t.doc_id"""

ORACLES["op9_superkmers"] = f"""WITH texts AS (SELECT doc_id, {SPLIT} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS words
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM texts WHERE len(ws) >= 20) w),
again AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS nth FROM windows) n
  WHERE nth > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS at FROM again),
words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM texts),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.at) AS text, count(*) AS n
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.at = w.at
  WHERE g.at IS NULL GROUP BY w.doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words,
       CAST(len(t.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id"""

ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLES["op10_chat"] = f"""WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'),
                        (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) v),
placed AS (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length('<turn ' || {ESCAPED.format('role')} || '>' || {ESCAPED.format('text')} || '</turn>') + 1)
           OVER w AS upto
  FROM given
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR nth = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_filter_audit"] = f"""WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {SPLIT} AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
facts AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN t.doc_id > f.least OR (t.doc_id IS NULL AND f.least IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN flags l ON l.doc_id = t.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(replace(replace(replace(replace('ABCDE', a.l, ''), b.l, ''), c.l, ''), d.l, '')) = 1
    AND replace(replace(replace(replace('ABCDE', a.l, ''), b.l, ''), c.l, ''), d.l, '') = e.l),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
tried AS (
  SELECT c.part, s.o, s.step, c.n, c.good, c.toxic, c.fails,
         contains(c.fails, s.o[s.step]) AS fails_here,
         s.step > 1 AND regexp_matches(c.fails, '[' || s.o[1 : s.step - 1] || '0]') AS went
  FROM cells c, steps s),
counted AS (
  SELECT part, o AS filter_order, step,
         CAST(coalesce(sum(n) FILTER (WHERE NOT fails_here AND NOT went), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE fails_here AND NOT went), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE fails_here AND went), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE fails = o[step]), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE fails_here AND NOT went), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE fails_here AND NOT went), 0) AS BIGINT) AS toxic_lost
  FROM tried GROUP BY part, o, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM counted"""

ORACLES["op12_exact_dedup"] = f"""WITH texts AS (SELECT doc_id, {LOWER} AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(t.text) AS text_sha256
FROM texts t JOIN groups g ON g.text = t.text"""
