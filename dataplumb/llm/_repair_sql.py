"""Damage to conversations and their cheapest repair as SQL, to compare with: a recursive query, one turn a step."""

from __future__ import annotations

# The checksum by a table of 256 numbers, each of eight divisions by its polynomial.
SQL = r"""
WITH RECURSIVE
crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)),
keyed AS (SELECT *, row_number() OVER () AS id, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: unicode(k[i])::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS f FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, f FROM summed WHERE f <> 0),
twice AS (SELECT h.* EXCLUDE f FROM hurt h, range(2) AS r(i) WHERE i = 0 OR f = 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM twice),
judged AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  left(role, 1) AS initial FROM numbered),
counted AS (SELECT conv_id, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(nth) AS n
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) || initial AS pair FROM judged) GROUP BY conv_id),
runs AS (SELECT * FROM (VALUES (0, 0, '', 0, ''), (0, 1, 'I', 2, 'u'), (0, 2, 'II', 3, 'ua'), (1, 0, '', 1, ''), (1, 1, 'I', 2, 'u'), (1, 2, 'II', 3, 'ua'),
  (2, 0, '', 2, ''), (2, 1, 'I', 3, 'a'), (2, 2, 'II', 2, 'au'), (3, 0, '', 3, ''), (3, 1, 'I', 2, 'u'), (3, 2, 'II', 3, 'ua')) AS v(p, n, code, m, made)),
edits AS (SELECT * FROM (VALUES ('D', 0, 0), ('D', 1, 1), ('D', 2, 2), ('D', 3, 3), ('R', 0, 2), ('R', 1, 2), ('R', 2, 3), ('R', 3, 2), ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS v(edit, m, q)),
moves AS (SELECT p, q, code || CASE WHEN edit IN ('D', 'R') THEN edit ELSE 'K' END AS code, made, edit, 5 * n + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS cost FROM runs JOIN edits USING (m)),
inserted AS (SELECT made, list_transform(range(1, len(made) + 1), lambda i: CASE made[i] WHEN 'u' THEN 'user:' ELSE 'assistant:' END) AS lines FROM (SELECT DISTINCT made FROM runs)),
walk AS (
  SELECT conv_id, 0::BIGINT AS nth, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.nth + 1, m.q, min({'cost': w.best.cost + m.cost + CASE WHEN j.fault = 3 AND m.edit <> 'D' THEN 5 ELSE 0 END, 'audit': w.best.audit || m.code,
    'lines': w.best.lines || i.lines || CASE m.edit WHEN 'D' THEN [] WHEN 'R' THEN [CASE m.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text] ELSE [j.role || ':' || j.text] END})
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.nth = w.nth + 1
  JOIN moves m ON m.p = w.q AND (m.edit = 'D' OR (j.fault NOT IN (1, 2) AND (m.edit = 'R' OR m.edit = j.initial))) JOIN inserted i USING (made)
  GROUP BY w.conv_id, w.nth, m.q),
ended AS (SELECT w.conv_id, min({'cost': w.best.cost + 5 * e.n, 'audit': w.best.audit || repeat('I', e.n), 'lines': w.best.lines || i.lines}) AS best
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.nth
  JOIN (VALUES (0, 0, ''), (3, 0, ''), (2, 1, 'a'), (0, 2, 'ua'), (1, 2, 'ua')) AS e(q, n, made) ON e.q = w.q JOIN inserted i USING (made) GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
