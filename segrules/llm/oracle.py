"""DuckDB SQL for the queries that SQL can express, by the contract's wording rather than the operator's method."""

from __future__ import annotations

# A-Z and the word break of the decontamination contract.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def decontamination_sql(docs: str) -> str:
    """Verdicts for the rows of the relation ``docs``."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM {docs}),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, ws[i:i + least(len(ws), 13) - 1] AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT rid, i, n, ws[i:i + n - 1] AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT p.rid, p.i, p.n, w.item_id FROM places p JOIN wins w ON p.n = w.n AND p.win = w.win),
covered AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS name FROM hits) GROUP BY rid)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


def line_dedup_sql(docs: str, columns: str) -> str:
    """``columns`` of the relation (doc_id, rid, n_lines, n_dropped, kept) for the rows of ``docs``."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
l AS (
  SELECT rid, doc_id, i, ls[i] AS line,
    translate(trim(ls[i], {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
hot AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, hot.k IS NOT NULL AND l.doc_id <> hot.keeper AS gone FROM l LEFT JOIN hot ON l.k = hot.k),
lined AS (
  SELECT rid, doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY rid, doc_id)
SELECT {columns} FROM lined"""


def near_dedup_sql(docs: str) -> str:
    """Components of the rows of ``docs``."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM {docs}),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(other, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(other, s.doc_id)) AS kept
FROM s LEFT JOIN least_id USING (doc_id)"""


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10"""

URLS = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, row_number() OVER () AS rid,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT rid, h || s AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h) DESC, length(s) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits ON p.rid = fits.rid AND k = 1"""

_NEAREST = """a{i} AS MATERIALIZED (
  SELECT rid, part, v, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.rid, x.part, x.v, c.entry, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM x JOIN c{i} c ON x.part = c.part)
  GROUP BY rid, part, v)"""
_MOVED = """c{j} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY pos) AS v FROM (
      SELECT part, entry, pos, floor(sum(v[pos])::DOUBLE / count(*))::BIGINT AS mean
      FROM (SELECT part, entry, v, unnest([1, 2, 3, 4]) AS pos FROM a{i}) GROUP BY part, entry, pos)
    GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)"""
VECTOR_CODES = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, part, q[4 * part + 1:4 * part + 4] AS v FROM (SELECT rid, q, unnest(range(16)) AS part FROM k)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM x WHERE rid <= 64),
{_NEAREST.format(i=0)},
{_MOVED.format(i=0, j=1)},
{_NEAREST.format(i=1)},
{_MOVED.format(i=1, j=2)},
{_NEAREST.format(i=2)},
coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
books AS (
  SELECT sha256(string_agg(v[pos]::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, v, unnest([1, 2, 3, 4]) AS pos FROM c2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN coded USING (rid), books"""

ORACLE_SQL = {
    "op3_decontamination": decontamination_sql("documents"),
    "op6_line_dedup": line_dedup_sql("documents", "doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256"),
    "op7_near_dedup": near_dedup_sql("documents"),
    "op10_topk_search": TOP_K,
    "op12_url_filter": URLS,
    "op13_vector_codes": VECTOR_CODES,
}
