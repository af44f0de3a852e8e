"""DuckDB SQL for the queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op6_url_filter"] = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, url, row_number() OVER () AS n,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, n,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
best AS (
  SELECT s.n, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM split s JOIN rules r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY s.n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (n)
"""

_ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_KINDS = [(0, _ASSIGN, 2, 6), (1, "AKIA[A-Z0-9]+", 0, 20), (2, "[0-9a-f]+", 0, 24), (3, "[A-Za-z0-9+/_-]+", 0, 20)]
_FOUND = "\n  UNION ALL ".join(
    f"SELECT n, {rank} AS rank, {group} AS grp, {least} AS least, '{pattern}' AS pattern,"
    f" regexp_extract_all(t, '{pattern}', 0) AS ms, string_split_regex(t, '{pattern}') AS gs FROM d"
    for rank, pattern, group, least in _KINDS
)
ORACLES["op7_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
u AS (
  SELECT n, rank, grp, least, pattern, ms[i] AS m,
         coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
  FROM f, unnest(range(1, len(ms) + 1)) AS x(i)),
c AS (
  SELECT n, rank, s, s + length(m) AS e,
         CASE WHEN grp = 2 THEN regexp_extract(m, '{_ASSIGN}', 2) ELSE m END AS v, least
  FROM u),
p AS (
  SELECT n, rank, s, e, v FROM c
  WHERE length(v) >= least AND (rank < 3 OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')))),
q AS (
  SELECT * FROM p WHERE rank < 3 OR NOT EXISTS (
    SELECT 1 FROM p b WHERE b.n = p.n AND b.rank < 3 AND b.s < p.e AND p.s < b.e)),
h AS (SELECT v, count(DISTINCT coalesce('x' || source, '')) AS owners FROM q JOIN d USING (n) GROUP BY v),
a AS (
  SELECT q.*, owners <= 2 AS live, ['assign', 'access', 'hex', 'owned'][rank + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS span
  FROM q JOIN h USING (v) WHERE rank < 3 OR owners <= 2),
g AS (
  SELECT n, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         count(*) FILTER (rank = 3) AS n_owned, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
         string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM a GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""

ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, first FROM p JOIN f USING (h))
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

ORACLES["op10_epsilon_join"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (
  SELECT n, vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.n AS a, b.n AS b FROM u a JOIN u b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(a, b) AS (SELECT n, n FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT r.a AS n, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.n = r.b GROUP BY r.a),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN named USING (n) LEFT JOIN counted USING (n)
"""
