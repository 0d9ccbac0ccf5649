"""SQL with the rows of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce({t}, ''), '{words}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DARK = r"[^\x20\x09-\x0D]+"


def _words(words: str) -> str:
    return _WORDS.format(t=_LOWER.format(t="text"), words=words)


DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_ALNUM)} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_words(_ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS x, least(len(w), 8) AS n FROM b, unnest(generate_series(1, greatest(len(w) - 7, 1))) t(i) WHERE len(w) > 0),
place AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM d, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) t(i)),
hit AS (SELECT r, i, n, item FROM place JOIN win USING (n, x)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit), unnest(generate_series(i, i + n - 1)) t(p) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_DARK)} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS x FROM d, unnest(generate_series(1, greatest(len(w) - 3, 1))) t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
z AS (SELECT r AS a, r AS b FROM d UNION SELECT z.a, e.b FROM z JOIN e ON z.b = e.a),
c AS (SELECT a AS r, min(doc_id) AS component_id FROM z JOIN d ON d.r = z.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS least FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> least THEN least END AS refers_to FROM p JOIN f USING (h)"""
