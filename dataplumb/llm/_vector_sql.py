"""Lloyd's rounds over parts of vectors as SQL, to compare with."""

from __future__ import annotations

_KEPT = r"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS nth, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT nth, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS r(p)),
book0 AS MATERIALIZED (SELECT p, nth - 1 AS e, x FROM pieces WHERE nth <= {entries})"""

_ASSIGN = r""",
code{k} AS MATERIALIZED (SELECT nth, p, min({{'d': list_dot_product(s.x, s.x) - 2 * list_dot_product(s.x, b.x) + list_dot_product(b.x, b.x), 'e': b.e}}) AS best
  FROM pieces s JOIN book{k} b USING (p) GROUP BY nth, p)"""

_UPDATE = r""",
mean{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, c.best.e AS e, i, floor(sum(s.x[i]) / count(*)) AS m
  FROM pieces s JOIN code{k} c USING (nth, p), range(1, (SELECT max(len(x)) FROM book0) + 1) AS r(i) GROUP BY p, c.best.e, i) GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""

_LAST = r""",
coded AS (SELECT nth, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM code{k} GROUP BY nth)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) FROM book{k}) AS codebooks_sha256
FROM kept JOIN coded USING (nth)"""


def sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [_ASSIGN.format(k=k) + _UPDATE.format(k=k, n=k + 1) for k in range(rounds)]
    return _KEPT.format(parts=parts, entries=entries) + "".join(steps) + _ASSIGN.format(k=rounds) + _LAST.format(k=rounds)
