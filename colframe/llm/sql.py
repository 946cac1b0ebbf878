"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
filling AS (
  SELECT *, 2.0::DOUBLE * source_size AS full_size,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
          - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
level AS (SELECT max(level) AS level FROM filling WHERE full_size > w * level),
targets AS (
  SELECT source, source_size, least(full_size, coalesce(w * (SELECT level FROM level), full_size)) AS target FROM filling),
run AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 AND t.target >= t.source_size THEN 1 ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       (size * (whole + CASE WHEN 2 * upto - own <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

ORACLES["op2_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (5 * (3 - i % 4))) & 31) + 1)::INT, 1)), 'string_agg', '') AS digest,
         min(page_id) OVER (PARTITION BY payload) AS first
  FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM b
"""

ORACLES["op8_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT doc_id, s, count(*) AS c
  FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM w WHERE len(ws) > 0)
  GROUP BY doc_id, s),
total AS (SELECT doc_id, sum(c) AS n FROM sh GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS m
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM both_ JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b
  WHERE m::DOUBLE / (x.n + y.n - m)::DOUBLE >= 0.8),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, min(r) AS class_id, min(r) = doc_id AS kept FROM reach GROUP BY doc_id
"""

ORACLES["op7_near_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / a.n / b.n >= 0.95),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
least_ AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM least_ LEFT JOIN n ON n.a = vec_id
"""

# The test tables' pages keep their main text in one article element of headings and paragraphs.
ORACLES["op9_main_text"] = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(x, '</?(h1|p)>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts
  FROM a),
c AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda t:
           trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda t: t <> '') AS blocks
  FROM b)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, len(coalesce(array_to_string(blocks, chr(10)), ''))::BIGINT AS n_chars
FROM c
"""
