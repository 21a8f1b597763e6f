"""DuckDB SQL of the queries that it can express."""

from __future__ import annotations

MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * CAST(2.0 AS DOUBLE) AS cap,
  CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w FROM s),
o AS (SELECT *, (SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER before, 0) AS remaining,
  (SELECT sum(w) FROM w) - coalesce(sum(w) OVER before, 0) AS heavy FROM w
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT remaining / heavy AS level FROM o WHERE remaining / heavy * w < cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM level) * w, cap)) AS target FROM w),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate)
  THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

#: Canonical links and refreshes of the plain form, with absolute targets, which are all that the tables may have.
URLS = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
e AS (SELECT split_part(url, '#', 1) AS a, split_part(b, '#', 1) AS b FROM (
  SELECT url, unnest(regexp_extract_all(html, '<link[^>]*rel="canonical"[^>]*href="([^"]+)"', 1)) AS b FROM pages
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '<meta[^>]*http-equiv="refresh"[^>]*url=([^">]+)', 1)) FROM pages)),
pair AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
walk AS (SELECT DISTINCT a AS node, a AS root FROM pair UNION SELECT b, root FROM walk JOIN pair ON a = node WHERE root < b),
grouped AS (SELECT node, min(root) AS component FROM walk GROUP BY node),
rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(verdict, rule_host, rule_path)),
every AS (SELECT host, path, split_part(url, '#', 1) AS node FROM p UNION
  SELECT regexp_extract(node, '^.*?://([^/?#]*)', 1), regexp_extract(node, '^.*?://[^/?#]*([^?#]*)', 1), node FROM grouped),
fit AS (SELECT DISTINCT ON (host, path) host, path, rule_host || rule_path AS rule, verdict FROM every JOIN rules
  ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path) ORDER BY host, path, length(rule_host || rule_path) DESC),
votes AS (SELECT component, bool_or(verdict = 'allow') AS allows, bool_or(verdict = 'block') AS blocks
  FROM grouped JOIN every USING (node) LEFT JOIN fit USING (host, path) GROUP BY component)
SELECT page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fit USING (host, path) LEFT JOIN grouped ON grouped.node = split_part(url, '#', 1) LEFT JOIN votes USING (component)
"""

ORACLE_SQL = {"op1_mixing": MIXING, "op8_url_filters": URLS}
