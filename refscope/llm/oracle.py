"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from refscope.llm.licenses import TEMPLATES

ORACLE: dict[str, str] = {}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

# Every run of lines, beginning or ending at a line, that just reaches 50 words; all but its first place goes.
ORACLE["op5_line_dedup"] = """
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM l
), o AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM w WHERE w > 0
), f AS (
  SELECT doc_id, pos, list(line) OVER a AS al, max(pos) OVER a AS ab, sum(w) OVER a AS aw,
         list(line) OVER b AS bl, min(pos) OVER b AS ba, sum(w) OVER b AS bw
  FROM (SELECT *, e - w AS s FROM o)
  WINDOW a AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), v AS (
  SELECT doc_id, pos AS a, ab AS b, al AS c FROM f WHERE aw >= 50
  UNION SELECT doc_id, ba, pos, bl FROM f WHERE bw >= 50
), g AS (
  SELECT c, min(ROW(doc_id, a, b)) AS o FROM v GROUP BY c HAVING count(*) > 1
), d AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = o[1] THEN greatest(a, o[3] + 1) ELSE a END, b + 1)) AS pos
  FROM v JOIN g USING (c) WHERE ROW(doc_id, a, b) > o
), k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL) AS kept,
         count(*) AS n_lines, count(d.pos) AS n_removed
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY 1
)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k"""

ORACLE["op10_decontamination"] = f"""
WITH i AS (SELECT CAST(item_id AS varchar) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS t, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
h AS (
  SELECT DISTINCT doc_id, p, n, item_id FROM (
    SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (
      SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
  ) JOIN iw USING (t, n)
), c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

ORACLE["op1_top_k"] = """
WITH e AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS bigint) AS score
  FROM e AS q, e AS c WHERE q.vec_id % 50 = 0 AND q.own <> c.own AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS integer) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLE["op3_url_filter"] = """
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), l AS (
  SELECT host || path AS k, bool_or(coalesce(contains(url, 'utm_source='), false)) AS listed FROM h GROUP BY 1
), u(v, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT page_id, url, max_by(rh || rp, len(rh || rp)) AS rule, max_by(v, len(rh || rp)) AS verdict
  FROM h JOIN u ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL
)
SELECT h.page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN l ON k = host || path LEFT JOIN m ON m.page_id = h.page_id AND m.url = h.url"""

_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in sorted(TEMPLATES.items()))
ORACLE["op9_license_scan"] = f"""
WITH f AS (
  SELECT doc_id, text, concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 100) AS bigint) AS varchar),
    CASE WHEN doc_id % 20 = 0 THEN 'LICENSE' ELSE 'doc' || CAST(doc_id AS varchar) || '.txt' END) AS path FROM documents
), t AS (SELECT * FROM (VALUES {_TEMPLATES}) v(license, body)),
tw AS (
  SELECT license, word, count(*) AS n FROM (SELECT license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS word FROM t) GROUP BY ALL
), total AS (SELECT count(*) AS n FROM f),
df AS (
  SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM f)
  WHERE word IN (SELECT word FROM tw) GROUP BY 1
), idf AS (
  SELECT word, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word), total
), tv AS (
  SELECT license, word, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY license)) AS x FROM tw JOIN idf USING (word)
), l AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS a FROM f)
), lw AS (
  SELECT doc_id, pos, word, count(*) AS n FROM (SELECT doc_id, pos, unnest(regexp_extract_all(line, '[a-z0-9]+')) AS word FROM l) GROUP BY ALL
), lv AS (SELECT doc_id, pos, word, n * coalesce(idf, ln(1 + (SELECT n FROM total)) + 1) AS x FROM lw LEFT JOIN idf USING (word)),
size AS (SELECT doc_id, pos, sqrt(sum(x * x)) AS size FROM lv GROUP BY ALL),
score AS (
  SELECT doc_id, license, round(sum(lv.x * tv.x) / any_value(size), 6) AS score
  FROM lv JOIN tv USING (word) JOIN size USING (doc_id, pos) GROUP BY doc_id, pos, license
), own AS (
  SELECT doc_id, arg_min(license, ROW(-score, license)) AS own, max(score) AS score FROM score WHERE score >= 0.8 GROUP BY 1
), r AS (
  SELECT doc_id, path, own, score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name
  FROM f LEFT JOIN own USING (doc_id)
), d AS (
  SELECT dir, max_by(own, ROW(score, own)) AS license FROM r
  WHERE own IS NOT NULL AND regexp_matches(name, '(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$') GROUP BY 1
), g AS (
  SELECT q.dir, arg_max(d.license, len(d.dir)) AS license, arg_max(d.dir, len(d.dir)) AS from_dir
  FROM (SELECT DISTINCT dir FROM r) q JOIN d ON q.dir = d.dir OR starts_with(q.dir, d.dir || '/') OR d.dir = '' GROUP BY 1
)
SELECT r.doc_id, path, own AS own_license, score, coalesce(own, g.license) AS license,
  CASE WHEN own IS NULL THEN from_dir END AS inherited_from
FROM r LEFT JOIN g USING (dir)"""


# A user's turn goes on from a reply or a system turn just before it, a reply from a user's turn.
ORACLE["op4_tool_calls"] = """
WITH t AS (
  SELECT *, lag(role) OVER c AS before, lag(turn) OVER c = turn - 1 AS near, lead(role) OVER c AS after, lead(turn) OVER c = turn + 1 AS next
  FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)
), k AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    coalesce(near AND CASE role WHEN 'user' THEN before <> 'user' WHEN 'assistant' THEN before = 'user' ELSE false END, false) AS goes_on,
    coalesce(next AND after = 'assistant', false) AS answered FROM t
), r AS (
  SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS position FROM r
)
SELECT conv_id, position, turn, kind, CASE kind WHEN 'call' THEN 'c' ELSE 'r' END || turn AS id,
  CASE kind WHEN 'result' THEN 'c' || (turn - 1) END AS call_id,
  CASE kind WHEN 'call' THEN answered WHEN 'result' THEN goes_on ELSE false END AS linked,
  CASE WHEN kind <> 'call' THEN '' WHEN text IS NULL THEN '$.question: missing' WHEN text = '' THEN '$.question: shorter than minLength'
    WHEN length(text) > 400 THEN '$.question: longer than maxLength' ELSE '' END AS errors,
  CASE kind
    WHEN 'call' THEN '{"arguments":{' || coalesce('"question":' || CAST(to_json(text) AS varchar) || ',', '') || '"turn":' || turn
      || '},"id":"c' || turn || '","kind":"call","name":"answer"}'
    WHEN 'result' THEN '{"call_id":"c' || (turn - 1) || '","content":' || coalesce(CAST(to_json(text) AS varchar), 'null')
      || ',"kind":"result","name":' || CASE WHEN goes_on THEN '"answer"' ELSE 'null' END || '}'
    ELSE '{"content":' || coalesce(CAST(to_json(text) AS varchar), 'null') || ',"kind":"message","role":' || coalesce(CAST(to_json(role) AS varchar), 'null') || '}'
  END AS json
FROM p"""
