"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH rules(host, path, verdict) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n FROM pages),
best AS (SELECT n, max_by(r.host || r.path, (length(r.host || r.path), length(r.host), r.verdict = 'block')) AS rule,
                max_by(r.verdict, (length(r.host || r.path), length(r.host), r.verdict = 'block')) AS says
         FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM p LEFT JOIN best USING (n)
"""

OP3 = r"""
WITH l AS (SELECT d.doc_id, d.n AS row_id, d.doc, u.i, d.lines[u.i] AS line,
                  list_transform(list_filter(string_split_regex(d.lines[u.i], '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
           FROM (SELECT doc_id, row_number() OVER () AS n, dense_rank() OVER (ORDER BY doc_id, text) AS doc, string_split(text, chr(10)) AS lines FROM documents) d, unnest(range(1, len(d.lines) + 1)) AS u(i)),
dl AS (SELECT DISTINCT w, len(w) AS n, w[1:3] AS lead, doc, doc_id FROM l WHERE len(w) > 0),
leaf AS (SELECT n, lead FROM dl GROUP BY n, lead HAVING count(DISTINCT doc) >= 5),
c AS (SELECT dl.* FROM dl JOIN leaf USING (n, lead)),
tok AS (SELECT c.n, c.lead, u.i AS pos, c.w[u.i] AS word, c.doc FROM c, unnest(range(1, c.n + 1)) AS u(i) WHERE c.w[u.i] <> '<*>'),
st AS (SELECT n, lead, pos, word FROM tok GROUP BY ALL HAVING count(DISTINCT doc) >= 5),
sh AS (SELECT k.w, k.n, k.lead, count(*) AS constant, list((st.pos, st.word) ORDER BY st.pos) AS template
       FROM (SELECT DISTINCT w, n, lead FROM c) k, unnest(range(1, k.n + 1)) AS u(i), st WHERE st.n = k.n AND st.lead = k.lead AND st.pos = u.i AND st.word = k.w[u.i] GROUP BY k.w, k.n, k.lead),
ok AS (SELECT c.w, c.n, c.lead, c.doc, c.doc_id, sh.template FROM c JOIN sh USING (w, n, lead) WHERE constant * 1000 >= c.n * 700),
rec AS (SELECT n, lead, template, min(doc_id) AS keeper FROM ok GROUP BY n, lead, template HAVING count(DISTINCT doc) >= 5),
passage AS (SELECT w, min(doc_id) AS keeper FROM dl WHERE n >= 50 AND len(list_filter(w, lambda x: x <> '<*>')) * 1000 >= n * 700 GROUP BY w HAVING count(DISTINCT doc) >= 2),
gone AS (SELECT w, min(keeper) AS keeper FROM (SELECT DISTINCT ok.w, rec.keeper FROM ok JOIN rec USING (n, lead, template) UNION ALL SELECT w, keeper FROM passage) GROUP BY w),
m AS (SELECT l.*, gone.w IS NOT NULL AND l.doc_id <> gone.keeper AS dropped FROM l LEFT JOIN gone ON l.w = gone.w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_md5
FROM m GROUP BY row_id, doc_id
"""

OP5 = r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS said FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
conv AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN n.said IS NULL THEN c.text ELSE 'Somebody wrote:' || chr(10) || coalesce('>> ' || replace(f.said, chr(10), chr(10) || '>> ') || chr(10), '')
                  || '> ' || replace(n.said, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(c.text, '') END AS text
         FROM conversations c LEFT JOIN said n ON n.conv_id = c.conv_id AND n.turn = c.turn - CASE c.turn % 4 WHEN 3 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END
                              LEFT JOIN said f ON f.conv_id = c.conv_id AND f.turn = c.turn - 2 AND c.turn % 4 = 2),
m AS (SELECT conv_id, turn, role, row_number() OVER () AS n, string_split(coalesce(text, ''), chr(10)) AS lines FROM conv),
raw AS (SELECT m.*, u.i, length(regexp_replace(regexp_extract(lines[u.i], '^[\x20\x09]*(?:>[\x20\x09]*)+'), '[^>]', '', 'g')) AS lv, regexp_replace(lines[u.i], '^[\x20\x09]*(?:>[\x20\x09]*)+', '') AS body
        FROM m, unnest(range(1, len(lines) + 1)) AS u(i)),
l AS (SELECT conv_id, turn, role, n, i, body, lower(trim(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g'))) AS plain,
             CASE WHEN lead(lv) OVER (PARTITION BY n ORDER BY i) > lv AND regexp_matches(body, '(?i)^.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$') THEN -1 ELSE lv END AS level FROM raw),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY n, level ORDER BY i) AS run FROM l WHERE plain <> '' AND level >= 0),
p AS (SELECT DISTINCT conv_id, turn, level, passage FROM (
        SELECT conv_id, turn, n, level, plain AS passage FROM l WHERE level >= 0
        UNION SELECT conv_id, turn, n, level, lower(trim(regexp_replace(string_agg(body, chr(10) ORDER BY i), '[\x20\x09-\x0D]+', ' ', 'g'))) FROM runs GROUP BY conv_id, turn, n, level, run
        UNION SELECT conv_id, turn, n, level, lower(trim(regexp_replace(string_agg(body, chr(10) ORDER BY i), '[\x20\x09-\x0D]+', ' ', 'g'))) FROM l WHERE level >= 0 GROUP BY ALL) WHERE passage <> ''),
o AS (SELECT conv_id, passage, min(turn) AS parent FROM p WHERE level = 0 GROUP BY ALL),
h AS (SELECT p.conv_id, p.turn, level, parent, sum(length(passage)) AS size FROM p JOIN o USING (conv_id, passage) WHERE level > 0 AND parent < p.turn GROUP BY ALL),
b AS (SELECT conv_id, turn, max_by(parent, (-level, size, parent)) AS parent_turn FROM h GROUP BY ALL),
t AS (SELECT conv_id, turn, parent_turn, parent_turn AS root, 1 AS depth, parent_turn || '/' || turn AS path FROM b
      UNION ALL SELECT t.conv_id, t.turn, t.parent_turn, b.parent_turn, depth + 1, b.parent_turn || '/' || t.path FROM t JOIN b ON b.conv_id = t.conv_id AND b.turn = t.root),
top AS (SELECT conv_id, turn, any_value(parent_turn) AS parent_turn, max_by(root, depth) AS root, max(depth) AS depth, max_by(path, depth) AS path FROM t GROUP BY ALL),
c AS (SELECT n, count(*) FILTER (WHERE level <> 0) AS n_quoted, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS own FROM l GROUP BY n)
SELECT m.conv_id, m.turn, m.role, top.parent_turn, coalesce(top.root, m.turn) AS root_turn, coalesce(top.depth, 0)::BIGINT AS depth, coalesce(top.path, m.turn::VARCHAR) AS path, c.n_quoted,
       '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || regexp_replace(c.own, '^(?:[\x20\x09\x0B-\x0D]*\n)+|(?:\n[\x20\x09\x0B-\x0D]*)+$', '', 'g') AS formatted
FROM m JOIN c USING (n) LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, left(md5('17:' || doc_id::VARCHAR), 16) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight FROM s),
c AS (SELECT *, source_size * 3 AS cap, sum(source_size) OVER () AS t, sum(weight) OVER () AS ws,
             coalesce(sum(source_size * 3) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS w_before
      FROM w WINDOW o AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, cap::HUGEINT * (ws - w_before) <= (t - cap_before) * weight AS clamped FROM c),
f AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE
        ELSE (t - coalesce(sum(cap) FILTER (WHERE clamped) OVER (), 0))::DOUBLE / (ws - coalesce(sum(weight) FILTER (WHERE clamped) OVER (), 0))::DOUBLE * weight END AS target FROM k),
r AS (SELECT d.*, f.source_size, f.target, round(f.target)::BIGINT AS goal, greatest(f.source_size, 1) AS n,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (goal // n * size + greatest(0, least(size, goal % n - used)))::BIGINT AS taken FROM r
"""

ORACLES = {"op1_url_filters": OP1, "op3_line_dedup": OP3, "op5_chat_quotes": OP5, "op7_mixing": OP7}
