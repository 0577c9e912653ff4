"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH i AS (SELECT row_number() OVER () AS n, item_id, {_WORDS.format(_FOLD.format("coalesce(text, '')"))} AS w FROM benchmark),
iw AS (SELECT *, least(5, len(w)) AS width FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT n, item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS shingle FROM iw),
size AS (SELECT n, count(*) AS n_shingles FROM s GROUP BY n),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_FOLD.format("coalesce(text, '')"))} AS w FROM documents),
ds AS (SELECT DISTINCT r, doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS shingle
  FROM d, (SELECT DISTINCT width FROM iw) WHERE len(w) >= width),
hit AS (SELECT r, doc_id, n, item_id, count(*) AS n_found FROM ds JOIN s USING (width, shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM hit JOIN size USING (n)
WHERE n_found >= ceil(0.8::DOUBLE * n_shingles - 1e-9)"""

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 50)),
least_ AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM win JOIN least_ USING (s) WHERE first < doc_id),
g AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""

OP8_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT p.*, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

OP9_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v,
  coalesce(len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
link AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.ok AND b.ok AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM e UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least_ AS (SELECT reach.a AS r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM e JOIN least_ USING (r) LEFT JOIN n USING (r)"""


def _places(name: str, pattern: str) -> str:
    """Leftmost non-overlapping matches of a pattern with their places, from the text between them."""
    return f"""
{name}_h AS (SELECT r, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d),
{name}_k AS (SELECT r, unnest(range(1, len(hits) + 1)) AS k, hits, gaps FROM {name}_h),
{name} AS (SELECT r, hits[k] AS hit, list_sum(list_transform(gaps[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)::BIGINT AS start FROM {name}_k)"""


_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_places('a', _ASSIGN)}, {_places('c', 'AKIA[A-Z0-9]+')}, {_places('x', '[0-9a-f]+')}, {_places('y', '[A-Za-z0-9+/_-]{20,}={0,2}')},
base AS (
  SELECT r, 0 AS kind, start, start + length(hit) AS stop FROM a WHERE length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 8
  UNION ALL SELECT r, 1, start, start + length(hit) FROM c WHERE length(hit) >= 16
  UNION ALL SELECT r, 2, start, start + length(hit) FROM x WHERE length(hit) >= 32),
cand AS (SELECT r, start, hit, CASE WHEN regexp_full_match(hit, '[0-9]+') THEN 3.2 WHEN regexp_full_match(hit, '[0-9a-f]+') THEN 3.2 WHEN regexp_full_match(hit, '[0-9A-F]+') THEN 3.2
    WHEN regexp_full_match(hit, '[0-9a-fA-F]+') THEN 3.5 WHEN regexp_full_match(hit, '[A-Za-z]+') THEN 4.0 ELSE 3.9 END::DOUBLE AS bits, row_number() OVER () AS n FROM y
  WHERE (regexp_matches(hit, '[0-9]') OR regexp_full_match(hit, '[A-Za-z]+')) AND (regexp_matches(hit, '[A-Za-z]') OR regexp_full_match(hit, '[0-9]+'))
    AND NOT regexp_full_match(hit, '[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}')
    AND NOT regexp_full_match(hit, '/?([A-Za-z_-]+/)+[A-Za-z0-9_-]{{0,19}}')),
win AS (SELECT n, r, start, bits, hit, e, string_split(hit[e - 19:e], '') AS w FROM (SELECT *, unnest(range(20, length(hit) + 1)) AS e FROM cand)),
hot AS (SELECT n, r, start, hit, e FROM win
  WHERE log2(20) - list_sum(list_transform(list_distinct(w), lambda c: len(list_filter(w, lambda o: o = c)) * log2(len(list_filter(w, lambda o: o = c))))) / 20 >= bits - 1e-9),
isle AS (SELECT *, sum(CASE WHEN e - before <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY e) AS isle FROM (SELECT *, lag(e) OVER (PARTITION BY n ORDER BY e) AS before FROM hot)),
extra AS (SELECT r, 3 AS kind, start + min(e) - 20 AS start, start + max(e) AS stop FROM isle GROUP BY n, r, start, hit, isle
  HAVING NOT regexp_matches(lower(hit[min(e) - 19:max(e)]), 'example|sample|placeholder|0123456789|abcdefghij|xxxxxx')),
named AS (SELECT r, kind, start, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)),
told AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS x, count(*) FILTER (kind = 3) AS e,
  coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, coalesce(e, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)"""

_NORMAL = r"lower(trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'), ' '))"

#: Quotes of conversations: lines, runs of one level, units, nearest earlier source, threads.
OP1_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
l AS (SELECT r, i, length(regexp_replace(regexp_extract(lines[i], '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(lines[i], '^[ \t]*((?:>[ \t]?)*)', '') AS content
  FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM m)),
q AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY r ORDER BY i) > level AND regexp_matches(content, '(?i)^[ \t]*(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$'), false) AS intro,
  CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY i) = level THEN 0 ELSE 1 END AS fresh FROM l),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) - 1 AS run FROM q),
runs AS (SELECT r, run, any_value(level) AS level, coalesce(list(content ORDER BY i) FILTER (NOT intro), []) AS lines FROM n GROUP BY r, run),
whole AS (SELECT r, flatten(list(lines ORDER BY run)) AS lines FROM runs WHERE level = 0 GROUP BY r),
parts AS (SELECT r, run, level, lines FROM runs UNION ALL SELECT r, -1, 0, lines FROM whole),
u AS (
  SELECT r, run, level, 3 AS grain, {_NORMAL.format("array_to_string(lines, chr(10))")} AS unit FROM parts
  UNION ALL SELECT r, run, level, 2, {_NORMAL.format("p")} FROM (SELECT r, run, level, unnest(regexp_split_to_array(array_to_string(lines, chr(10)), '\n[ \t]*\n')) AS p FROM parts)
  UNION ALL SELECT r, run, level, 1, x FROM (SELECT r, run, level, {_NORMAL.format("y")} AS x FROM (SELECT r, run, level, unnest(lines) AS y FROM parts)) WHERE length(x) >= 12 OR level = 0),
known AS (SELECT u.*, m.conv_id, m.turn FROM u JOIN m USING (r) WHERE unit <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
own AS (SELECT DISTINCT conv_id, turn, unit FROM known WHERE level = 0),
met AS (SELECT k.r, k.run, k.level, k.grain, k.unit, max(o.turn) AS source FROM known k JOIN own o ON o.conv_id = k.conv_id AND o.unit = k.unit AND o.turn < k.turn WHERE k.level > 0 GROUP BY ALL),
votes AS (SELECT r, run, level, source, max(grain) AS grain, sum(length(unit)) AS chars FROM met GROUP BY ALL),
best AS (SELECT r, run, level, arg_max(source, {{'g': grain, 'c': chars, 's': source}}) AS origin FROM votes GROUP BY ALL),
reply AS (SELECT conv_id, turn, arg_min(origin, {{'l': level, 'o': -origin}}) AS reply_to, count(*) AS n_linked FROM best JOIN m USING (r) GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM reply UNION ALL SELECT up.conv_id, up.turn, reply.reply_to, depth + 1 FROM up JOIN reply ON reply.conv_id = up.conv_id AND reply.turn = up.root),
top AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL),
node AS (SELECT conv_id, turn, reply_to, coalesce(n_linked, 0) AS n_linked, coalesce(root, turn) AS thread, coalesce(depth, 0)::INT AS depth
  FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) LEFT JOIN reply USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, depth, turn) - 1 AS position FROM node),
body AS (SELECT r, regexp_replace(coalesce(string_agg(array_to_string(lines, chr(10)), chr(10) ORDER BY run) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS body, count(*) FILTER (level > 0) AS n_quotes FROM runs GROUP BY r)
SELECT m.conv_id, m.turn, m.role, body, n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to, thread, depth, position, json_object('role', role, 'content', body)::VARCHAR AS chat
FROM m JOIN body USING (r) LEFT JOIN placed ON placed.conv_id = m.conv_id AND placed.turn = m.turn"""


_FEATURES = rf"regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Importance resampling; the CRC-32 of each distinct word by a table of 256 remainders.
OP12_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) AS n(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS w FROM documents),
df AS (SELECT r, unnest(w) AS w FROM d),
bf AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM df UNION SELECT w FROM bf)),
coded AS (SELECT w, xor(list_reduce(list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM hexed, crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN coded USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN coded USING (w) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM df) AS all_s, (SELECT count(*) FROM bf) AS all_t),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
weight AS (SELECT r, sum(gain)::BIGINT AS weight FROM df JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS wanted FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= wanted THEN place END AS rank FROM placed"""

#: Main text of the given pages, whose article element is the article: its tags taken out, its references decoded.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS marked FROM pages),
t AS (SELECT page_id, url, regexp_replace(replace(replace(replace(marked, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS plain FROM a)
SELECT page_id, url, trim(regexp_replace(plain, '[\s\p{Z}]+', ' ', 'g')) AS text, length(trim(regexp_replace(plain, '[\s\p{Z}]+', ' ', 'g'))) AS n_chars FROM t"""
