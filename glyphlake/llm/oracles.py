"""DuckDB SQL for the queries that SQL expresses; the others are tested against brute force."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "[^\\x20\\x09-\\x0D]+"

URL_FILTER = f"""
WITH rules(action, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
         FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)] END) AS s FROM w),
flat AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, comp) AS (SELECT doc_id, doc_id FROM sets UNION SELECT q, comp FROM reach JOIN links ON p = doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, comp AS component_id FROM sets JOIN (SELECT doc_id, min(comp) AS comp FROM reach GROUP BY doc_id) USING (doc_id)"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
owner AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM win JOIN owner USING (k), range(13) t(o) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, count(g.j) AS removed, string_agg(CASE WHEN g.j IS NULL THEN word END, ' ' ORDER BY j) AS text FROM words LEFT JOIN gone g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(number: int, kind: str, pattern: str, group: int) -> str:
    return f"SELECT doc_id, {number} AS k, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, string_split_regex(text, '{pattern}') AS p FROM t"


#: A match starts behind what stands between the matches before it, and these.
SECRET_BASE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_matches(0, "assign", _ASSIGN, 2)} UNION ALL {_matches(1, "access", "AKIA[A-Z0-9]+", 0)} UNION ALL {_matches(2, "hex", "[0-9a-f]{24,}", 0)}),
hits AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw),
places AS (SELECT doc_id, k, kind, coalesce(list_sum([length(x) for x in p[1:i]]), 0)::BIGINT + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0)::BIGINT AS s, length(m[i]) AS n, length(g[i]) AS g FROM hits),
fit AS (SELECT * FROM places WHERE CASE k WHEN 0 THEN g >= 6 WHEN 1 THEN n >= 20 ELSE true END),
found AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM fit GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN found USING (doc_id)"""

QUALITY_BASE = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + o) AS r FROM twice, range(5) s(o) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
parts AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
          (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM parts"""
