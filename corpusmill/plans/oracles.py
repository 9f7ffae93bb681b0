"""DuckDB SQL that gives the rows of the registered queries, built from the same fixed values."""

from __future__ import annotations


from corpusmill.config import DownsampleConfig
from corpusmill.operators.near_dedup import PRIME, coefficients
from corpusmill.operators.recall import CODE_HINTS
from corpusmill.sources.languages import DATA, LANGUAGE_OF, TEXT

WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORDCHARS = r"\p{L}\p{N}_"
_quote = lambda s: "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[{WORDCHARS}]+|[^{WS}{WORDCHARS}]'))"


def u01(c: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {c}), 1, 8))::BIGINT / 4294967296.0)"


def docs(suffix: str | None = None) -> str:
    ext = f"'{suffix}'" if suffix else "(['py','java','html','md','json','c','js','zzz'])[doc_id % 8 + 1]"
    return f"""d AS (SELECT text AS content, source || '/' || doc_id || '.' || {ext} AS path, coalesce(q, 0)::BIGINT AS stars, doc_id::DOUBLE AS commit_time, source, doc_id::VARCHAR AS doc_id, doc_id AS ord
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id))"""


_LANGUAGE = "CASE " + " ".join(f"WHEN ext = {_quote(e)} THEN {_quote(lang)}" for e, lang in LANGUAGE_OF.items()) + " END"
_IN = lambda names: "(" + ", ".join(map(_quote, names)) + ")"


def admitted(suffix: str | None = None) -> str:
    return docs(suffix) + rf""",
e AS (SELECT * REPLACE (regexp_replace(regexp_replace(content, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g') AS content), lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^\.*[^.].*\.([^.]*)$', 1)) AS ext FROM d),
a AS (SELECT * FROM (SELECT *, {_LANGUAGE} AS language FROM e) WHERE language IS NOT NULL AND length(content) >= 1 AND strlen(content) <= 8388608),
b AS (SELECT *, CASE WHEN language IN {_IN(DATA)} THEN 'data' WHEN language IN {_IN(TEXT)} THEN 'text' ELSE 'code' END AS category FROM a)"""


def signals(suffix: str | None = None) -> str:
    share = lambda p: f"(length(content) - length(regexp_replace(content, '{p}', '', 'g')))::DOUBLE / greatest(length(content), 1)"
    ratio = lambda test: f"len(list_filter(lines, lambda x: {test}))::DOUBLE / len(lines)"
    quoted = "regexp_extract_all(x, '\"[^\"]*\"|''[^'']*''')"
    inner = f"regexp_extract_all(q[2:-2], '[^{WS}]+')"
    return admitted(suffix) + rf""",
s0 AS (SELECT *, string_split(content, chr(10)) AS lines FROM b),
s AS (SELECT *, {share(r'\p{L}')} AS fraction_alphabetic, {share('[' + chr(92) + 'p{Nd}²³¹⁰⁴-⁹₀-₉]')} AS fraction_numeric, {share('[' + WS + ']')} AS fraction_whitespace,
  len(lines)::DOUBLE AS num_lines, list_sum(list_transform(lines, lambda x: length(x)))::DOUBLE / len(lines) AS mean_line_length, list_max(list_transform(lines, lambda x: length(x)))::DOUBLE AS max_line_length,
  length(array_to_string(regexp_extract_all(content, '\b0[xX][0-9a-fA-F]+\b|\b[0-9a-fA-F]{{8,}}\b'), ''))::DOUBLE / greatest(length(content), 1) AS hex_char_ratio,
  {ratio(f"len(list_filter({quoted}, lambda q: len({inner}) > 12)) > 0")} AS long_string_line_ratio,
  coalesce(list_sum(list_transform(flatten(list_transform(lines, lambda x: flatten(list_transform({quoted}, lambda q: {inner})))), lambda w: CASE WHEN length(w) > 20 THEN length(w) ELSE 0 END)), 0)::DOUBLE
    / greatest(list_sum(list_transform(lines, lambda x: length(x))), 1) AS long_string_word_char_ratio,
  {ratio("regexp_matches(x, '(?i)(your code here|you code here|todo|fixme|xxx|implement me|not implemented)')")} AS placeholder_line_ratio,
  {ratio("contains(x, 'assert')")} AS assert_line_ratio,
  CASE WHEN language = 'Python' THEN {ratio(f"regexp_matches(x, '^[{WS}]*(async )?def ')")} END AS python_func_line_ratio,
  CASE WHEN language = 'Python' THEN {ratio(f"regexp_matches(x, '^[{WS}]*(import |from )')")} END AS python_import_line_ratio FROM s0)"""


_NL = "list_filter([CASE WHEN fraction_alphabetic < 0.25 THEN 'nl_low_alpha' END, CASE WHEN fraction_numeric > 0.5 THEN 'nl_high_numeric' END, CASE WHEN num_lines < 3 THEN 'nl_too_few_lines' END, CASE WHEN mean_line_length > 200 THEN 'nl_long_mean_line' END, CASE WHEN max_line_length > 2000 THEN 'nl_long_max_line' END], lambda x: x IS NOT NULL)"
_RULED = "WITH " + signals("txt") + f", r AS (SELECT *, {_NL} AS fired FROM s) "
_NAMES = "fraction_alphabetic, fraction_numeric, fraction_whitespace, num_lines, mean_line_length, max_line_length, hex_char_ratio, long_string_line_ratio, long_string_word_char_ratio, placeholder_line_ratio, assert_line_ratio, python_func_line_ratio, python_import_line_ratio"


def ngrams(c: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' ')))"


_WORDS = f"regexp_extract_all(lower(text), '[^{WS}]+')"
_BANNED = f"g AS (SELECT DISTINCT unnest({ngrams('w', 10)}) AS gram FROM (SELECT {_WORDS} AS w FROM benchmark))"
_A, _B = coefficients(16, 1)
_SIGNED = "WITH " + docs() + f""",
w AS (SELECT *, regexp_extract_all(content, '[^{WS}]+') AS w FROM d),
h AS (SELECT *, CASE WHEN len(w) = 0 THEN []::BIGINT[] ELSE list_transform(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END),
  lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {PRIME}) END AS h FROM w),
sg AS (SELECT *, CASE WHEN len(h) = 0 THEN []::BIGINT[] ELSE list_transform(range(1, 17), lambda i: list_min(list_transform(h, lambda x: ({_A}[i] * x + {_B}[i]) % {PRIME}))) END AS signature FROM h)"""
_BUCKETS = _SIGNED + """,
k AS (SELECT ord, i AS band, md5(array_to_string(signature[i * 2 + 1 : i * 2 + 2], ',')) AS key FROM sg, unnest(range(0, 8)) AS u(i) WHERE len(signature) > 0 UNION ALL SELECT ord, -1, '' FROM sg WHERE len(signature) = 0)"""
_CLUSTERS = _BUCKETS.replace("WITH d", "WITH RECURSIVE d", 1) + """,
ed AS (SELECT DISTINCT ord AS u, min(ord) OVER (PARTITION BY band, key) AS v FROM k), sym AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed),
reach AS (SELECT u AS ord, u AS v FROM (SELECT DISTINCT u FROM sym) UNION SELECT reach.ord, sym.v FROM reach JOIN sym ON reach.v = sym.u),
cl AS (SELECT ord, min(v) AS cluster FROM reach GROUP BY ord)"""
_DOWN = "CASE language " + " ".join(f"WHEN {_quote(k)} THEN {v!r}" for k, v in DownsampleConfig().keep.items()) + " ELSE 1.0 END"
_IDENT = "list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x)))"
_BAYES = f"""seed AS (SELECT text AS content, label FROM documents JOIN (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id) USING (doc_id)),
t AS (SELECT sum(label) AS pos, sum(1 - label) AS neg FROM seed),
tk AS (SELECT token, sum(p) AS p, sum(q) AS q FROM (SELECT unnest({_IDENT}) AS token, label AS p, 1 - label AS q FROM seed UNION ALL SELECT unnest([{', '.join(map(_quote, CODE_HINTS))}]), 0, 0) GROUP BY token),
wt AS (SELECT token, ln((p + 1) / (pos + 2)::DOUBLE) - ln((q + 1) / (neg + 2)::DOUBLE) AS weight, ln((pos + 1) / (neg + 1)::DOUBLE) AS bias FROM tk, t)"""
_RECALL = "WITH " + _BAYES + rf""",
p AS (SELECT page_id::VARCHAR AS doc_id, html AS content, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
n AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name FROM p),
f AS (SELECT *, contains(name, 'requirement') OR regexp_replace(name, '^(\.*[^.].*)\.[^.]*$', '\1') IN ('readme', 'notes', 'todo', 'description', 'cmakelists') AS named FROM n),
sc AS (SELECT doc_id, sum(weight) AS s FROM (SELECT doc_id, unnest({_IDENT}) AS token FROM f WHERE NOT named) JOIN wt USING (token) GROUP BY doc_id),
z AS (SELECT f.*, 1 / (1 + exp(-((SELECT max(bias) FROM wt) + coalesce(s, 0)))) AS prob FROM f LEFT JOIN sc USING (doc_id))
SELECT doc_id, path, CASE WHEN NOT named THEN round(round(prob, 4), 3) END AS code_prob FROM z WHERE named OR prob >= 0.5"""
_ENTRY = rf"regexp_matches(text, '(?:^|[^{WORDCHARS}])(?:stupid|idiot|achlichau)(?:$|[^{WORDCHARS}])')"
_JUDGED = "WITH " + _BANNED + f""",
x AS (SELECT doc_id, text, {_WORDS} AS w, {_ENTRY} AS entry FROM documents),
hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({ngrams('w', 10)}) AS gram FROM x WHERE NOT entry) SEMI JOIN g USING (gram)),
j AS (SELECT x.doc_id, CASE WHEN entry THEN 'entry_point' WHEN hit.doc_id IS NOT NULL THEN 'ngram' END AS reason FROM x LEFT JOIN hit ON x.doc_id = hit.doc_id) """
_KEYS = "+".join(f"contains(lower(path || chr(10) || content), '{k}')::BIGINT" for k in ("ation", "keit", "eux", "ción"))
_TARGETS = "tg(source, share, target) AS (VALUES ('src0', 0.5::DOUBLE, 100000), ('src1', 0.25::DOUBLE, 50000), ('src2', 0.125::DOUBLE, 25000), ('src3', 0.125::DOUBLE, 25000))"
_MIXED = "WITH " + docs() + f""", {_TARGETS},
n AS (SELECT d.*, {tokens('content')} AS tokens FROM d),
m AS (SELECT n.doc_id, n.source, tokens, target, coalesce(sum(tokens) OVER (PARTITION BY n.source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n JOIN tg USING (source)),
mx AS (SELECT doc_id, source, tokens FROM m WHERE before < target) """
_QUOTAS = "q(stage, source, target) AS (VALUES (1, 'src0', 20), (1, 'src1', 5), (1, 'none', 7), (2, 'src2', 11), (2, 'src3', 1000000))"
_COMPOSED = f"""WITH {_QUOTAS}, o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {u01('doc_id', 42)}, doc_id) AS rn FROM documents),
cp AS (SELECT doc_id, o.source, stage FROM o JOIN q ON o.source = q.source WHERE rn <= target) """
_PAIRS = """WITH tn AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pr AS (SELECT conv_id, turn, text AS instruction, response FROM tn WHERE role = 'user' AND next_role = 'assistant') """
_SYSTEM = "'<|system|>' || chr(10) || 'You are a helpful programming assistant.' || chr(10) || '<|user|>' || chr(10)"
_CHAT = f"{_SYSTEM} || {strip('instruction')} || chr(10) || '<|assistant|>' || chr(10) || {strip('response')} || chr(10) || '<|end|>'"
_SEGMENTS = """WITH n AS (SELECT doc_id AS ord, text, (strlen(text) + 1)::BIGINT AS n, coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM documents),
sg AS (SELECT u.block, ord, text, greatest(pos, u.block * 2048) - u.block * 2048 AS block_start, greatest(pos, u.block * 2048) - pos AS doc_start, least(pos + n, (u.block + 1) * 2048) - greatest(pos, u.block * 2048) AS length
  FROM n, unnest(range(pos // 2048, (pos + n - 1) // 2048 + 1)) AS u(block) WHERE u.block < (SELECT (sum(n) // 2048)::BIGINT FROM n)) """
_SUM = lambda h, a, b: f"list_sum(list_transform(range({a}, {b}), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT))"
_MASK = _PAIRS + f""", bt AS (SELECT conv_id, turn, hex(encode({_SYSTEM} || instruction || chr(10) || '<|assistant|>' || chr(10))) AS p, hex(encode(response || chr(10) || '<|end|>')) AS r FROM pr)
SELECT conv_id, turn, 256::BIGINT AS n, {_SUM('(p || r)', '0', 'least(256, len(p || r) // 2)')}::BIGINT AS id_sum, greatest(0, least(256, len(p || r) // 2) - len(p) // 2)::BIGINT AS n_response FROM bt"""
_INGESTED = r"""WITH ro AS (SELECT doc_id AS i, CASE WHEN doc_id % 11 <> 3 THEN 'b' || doc_id END AS blob_id, source || '/' || doc_id || '.py' AS path, source AS repo_name,
  CASE WHEN doc_id % 13 = 5 THEN 9000000 ELSE strlen(text) END AS n, doc_id % 100 AS stars, CASE WHEN doc_id % 3 = 0 THEN (1600000000 + doc_id)::DOUBLE ELSE 1683356889.0 END AS commit_time, doc_id % 17 <> 4 AS there, CASE WHEN doc_id % 19 = 6 THEN '' ELSE text END AS content FROM documents),
st AS (SELECT *, CASE WHEN n > 8388608 THEN 'skip_too_large' WHEN blob_id IS NULL THEN 'skip_no_blob' WHEN NOT there OR content IS NULL THEN 'skip_fetch_error' WHEN content = '' THEN 'skip_empty' ELSE 'yielded' END AS status FROM ro) """
_COUNTS = "WITH ct AS (SELECT page_id::VARCHAR AS task_id, page_id % 7 + 3 AS n, (page_id * 5) % (page_id % 7 + 4) AS c FROM pages), ek AS (SELECT *, CASE WHEN n - c < k THEN 1.0 WHEN c <= 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i::DOUBLE)) END AS p FROM ct, unnest([1, 2, 5]) AS u(k)) "
_BLOCKS = lambda c: f"CASE WHEN len(regexp_extract_all({c}, '(?s)```(?:[a-zA-Z0-9_+-]*)\\n(.*?)```', 1)) > 0 THEN list_transform(regexp_extract_all({c}, '(?s)```(?:[a-zA-Z0-9_+-]*)\\n(.*?)```', 1), lambda x: {strip('x')}) WHEN {strip(c)} <> '' THEN [{strip(c)}] ELSE []::VARCHAR[] END"
_STOPS = ("\nclass ", "\ndef ", "\n#", "\nif __name__", "\nprint(", "\n@", "\n```", "\nassert ", "\nimport ", "\nfrom ")
_CUT = lambda c: f"left({c}, coalesce(least({', '.join('nullif(strpos(' + c + ', ' + _quote(s).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) + '), 0)' for s in _STOPS)}), length({c}) + 1) - 1)"
_KEPT = f"""{strip("array_to_string(list_transform(list_filter(sn, lambda x: NOT regexp_matches(lower(x), 'subscribe|advertisement|cookie|sign up|buy now|©')), lambda x: " + strip('x') + "), ' ')")}"""
_PROMPT = "'[intent:educational]' || chr(10) || 'Turn the following code snippet into a concise educational passage that teaches the key concept it demonstrates.' || chr(10) || chr(10) || 'Snippet:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10)"
_RE = {
    "key": r"(?s)-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
    "secret": r"""(?i)\b(password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|token)\b(\s*[:=]\s*)(?:(")[^"]+"|('')[^'']+''|(["''])[^\s,;]*|[^\s,;]+)""",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "ip4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "ip6": r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b",
}
_n = lambda c, k: f"len(regexp_extract_all({c}, '{_RE[k]}'))"
_s = lambda c, k, new: f"regexp_replace({c}, '{_RE[k]}', '{new}', 'g')"
_PII = "WITH " + docs() + f""",
p1 AS (SELECT doc_id, {_n('content', 'key')} AS private_key, {_s('content', 'key', '<key>')} AS c FROM d),
p2 AS (SELECT doc_id, private_key, {_n('c', 'secret')} AS secret, {_s('c', 'secret', chr(92) + '1' + chr(92) + '2' + chr(92) + '3' + chr(92) + '4' + chr(92) + '5<password>' + chr(92) + '3' + chr(92) + '4' + chr(92) + '5')} AS c FROM p1),
p3 AS (SELECT doc_id, private_key, secret, {_n('c', 'email')} AS email, {_s('c', 'email', '<email>')} AS c FROM p2),
p4 AS (SELECT doc_id, private_key, secret, email, {_n('c', 'ip4')} AS ip4, {_s('c', 'ip4', '<ip_address>')} AS c FROM p3)
SELECT doc_id, md5({_s('c', 'ip6', '<ip_address>')}) AS content_md5, email, ip4 + {_n('c', 'ip6')} AS ip, secret, private_key FROM p4"""
_FENCED = "CASE WHEN doc_id % 2 = 0 THEN 'Say:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```' || chr(10) || lang || chr(10) || '```' ELSE text END"

ORACLES = {
    "admit_documents": "WITH " + admitted() + " SELECT doc_id, path, language, category, strlen(content)::BIGINT AS n_bytes FROM b",
    "language_category_counts": "WITH " + admitted() + " SELECT language, category, count(*) AS n FROM b GROUP BY ALL",
    "exact_dedup": "WITH " + docs() + " SELECT doc_id, stars, commit_time FROM d QUALIFY row_number() OVER (PARTITION BY sha256(content) ORDER BY stars DESC, commit_time DESC, ord) = 1",
    "quality_signals": "WITH " + signals() + f" SELECT doc_id, {_NAMES} FROM s",
    "rule_annotate": _RULED + "SELECT doc_id, array_to_string(fired, ',') AS filtered_by FROM r",
    "rule_hits": _RULED + "SELECT rule, count(*) AS n FROM (SELECT unnest(fired) AS rule FROM r) GROUP BY ALL",
    "filtered_docs": _RULED + "SELECT doc_id FROM r WHERE len(fired) = 0",
    "pii_redact": _PII,
    "minhash_signature": _SIGNED + " SELECT ord, array_to_string(signature, ',') AS signature FROM sg",
    "lsh_buckets": _BUCKETS + " SELECT band::INT AS band, key, count(*) AS n, min(ord) AS least FROM k GROUP BY ALL HAVING count(*) > 1",
    "near_dup_components": _CLUSTERS + " SELECT ord, cluster FROM cl",
    "near_dedup_small": _CLUSTERS + " SELECT doc_id, stars FROM d JOIN cl USING (ord) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY stars DESC, commit_time DESC, ord) = 1",
    "downsample_languages": "WITH " + admitted() + f" SELECT doc_id, language FROM b WHERE {u01('doc_id', 42)} < {_DOWN}",
    "pipeline_stage_counts": _RULED + """, ex AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sha256(content) ORDER BY stars DESC, commit_time DESC, ord) = 1)
SELECT '0_input' AS stage, count(*) AS n FROM d UNION ALL SELECT '1_preprocess', count(*) FROM r UNION ALL SELECT '2_exact_dedup', count(*) FROM ex UNION ALL SELECT '3_fuzzy_dedup', count(*) FROM ex
UNION ALL SELECT '4_transform', count(*) FROM ex UNION ALL SELECT '5_filter', count(*) FROM ex WHERE len(fired) = 0 UNION ALL SELECT '6_downsample', count(*) FROM ex WHERE len(fired) = 0""",
    "nb_weights": "WITH " + _BAYES + " SELECT token, round(weight, 6) AS weight, round(bias, 6) AS bias FROM wt",
    "web_recall": _RECALL,
    "banned_ngrams": "WITH " + _BANNED + " SELECT gram FROM g",
    "decontaminate": _JUDGED + "SELECT doc_id, reason FROM j",
    "decontam_report": _JUDGED + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM j GROUP BY ALL",
    "algorithmic_sample": "WITH " + docs() + f" SELECT doc_id, 'algorithmic' AS source, {_KEYS} AS keyword_hits FROM d WHERE {_KEYS} >= 2",
    "budget_mixture": _MIXED + "SELECT doc_id, source, tokens FROM mx",
    "mixture_report": _MIXED + "SELECT tg.source, count(mx.doc_id) AS docs, coalesce(sum(tokens), 0)::BIGINT AS tokens, any_value(share) AS target_share, round(coalesce(sum(tokens), 0) / (SELECT greatest(sum(tokens), 1) FROM mx)::DOUBLE, 9) AS actual_share FROM tg LEFT JOIN mx ON tg.source = mx.source GROUP BY tg.source",
    "compose_quota": _COMPOSED + "SELECT doc_id, source, stage FROM cp",
    "compose_report": _COMPOSED + "SELECT q.stage, q.source, target::BIGINT AS target, count(cp.doc_id) AS actual FROM q LEFT JOIN cp ON q.stage = cp.stage AND q.source = cp.source GROUP BY ALL",
    "dialogue_pairs": _PAIRS + "SELECT * FROM pr",
    "realuser_filter": _PAIRS + f", sp AS (SELECT conv_id, turn, {strip('instruction')} AS i, {strip('response')} AS r FROM pr) SELECT conv_id, turn, CASE WHEN length(r) < 40 AND conv_id % 2 = 0 THEN 'def f(): pass' ELSE r END AS response, length(r) < 40 AND conv_id % 2 = 0 AS regenerated, 'realuser_instruct' AS source, 'Python' AS language FROM sp WHERE i <> '' AND regexp_matches(i || chr(10) || r, '(?i)tion|ing') AND (r <> '' OR conv_id % 2 = 0)",
    "chat_format": _PAIRS + f", ch AS (SELECT conv_id, turn, {_CHAT} AS text FROM pr) SELECT conv_id, turn, text, {tokens('text')} AS tokens FROM ch",
    "token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "pack_segments": _SEGMENTS + "SELECT block::BIGINT AS block, ord, block_start::BIGINT AS block_start, doc_start::BIGINT AS doc_start, length::BIGINT AS length FROM sg",
    "pack_blocks": _SEGMENTS + f", hx AS (SELECT block, hex(encode(text || chr(10)))[doc_start * 2 + 1 : (doc_start + length) * 2] AS h, length FROM sg) SELECT block::BIGINT AS block, sum({_SUM('h', '0', 'length')})::BIGINT AS id_sum, sum(length)::BIGINT AS n FROM hx GROUP BY block",
    "sft_mask": _MASK,
    "ingest_gates": _INGESTED + "SELECT status, count(*) AS n FROM st GROUP BY ALL",
    "ingest_documents": _INGESTED + "SELECT blob_id AS doc_id, path, repo_name, stars, commit_time, 'code' AS category FROM st WHERE status = 'yielded'",
    "pass_at_k": _COUNTS + "SELECT task_id, k, round(p, 9) AS p FROM ek",
    "pass_at_k_mean": _COUNTS + "SELECT k, round(avg(p), 9) AS pass_at_k, count(*) AS n_problems, count(*) FILTER (WHERE c > 0) AS n_solved FROM ek GROUP BY k",
    "extract_code_blocks": f"WITH x AS (SELECT doc_id, {_FENCED} AS t FROM documents), y AS (SELECT doc_id, {_BLOCKS('t')} AS b FROM x) SELECT doc_id, len(b) AS n, md5(b[1]) AS first_md5, md5(b[-1]) AS last_md5 FROM y",
    "completion_truncate": f"WITH x AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'print(1)' || chr(10) || 'class A' ELSE '' END AS t FROM documents) SELECT doc_id, md5({_CUT('t')}) AS text_md5 FROM x",
    "build_programs": f"""WITH x AS (SELECT doc_id, source, lang, text AS t, {_BLOCKS('text')} AS b FROM documents), y AS (SELECT *, list_filter(b, lambda z: contains(z, 'def ' || lang))[1] AS full_block,
  source || CASE WHEN starts_with(t, source) THEN {_CUT('substr(t, length(source) + 1)')} ELSE {_CUT('t')} END AS own FROM x)
SELECT doc_id, md5(coalesce(full_block, own) || chr(10) || chr(10) || 'def check(f): pass' || chr(10) || chr(10) || 'check(' || lang || ')' || chr(10)) AS completion_md5,
  md5(CASE WHEN doc_id % 2 = 0 THEN 'import math' || chr(10) ELSE '' END || coalesce(b[-1], {strip('t')}) || chr(10) || 'assert a' || chr(10) || 'assert b' || chr(10)) AS function_md5 FROM y""",
    "clean_seeds": f"WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]+[.!?]') AS s0 FROM documents), y AS (SELECT *, CASE WHEN len(s0) > 0 THEN s0 ELSE [text] END AS sn FROM x), z AS (SELECT doc_id, text, {_KEPT} AS kept FROM y) SELECT doc_id, md5(CASE WHEN kept <> '' THEN kept ELSE {strip('text')} END) AS text_md5 FROM z",
    "teacher_misses": f"SELECT DISTINCT length({_PROMPT})::BIGINT AS n_chars, md5({_PROMPT}) AS prompt_md5 FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "textbook_passages": "SELECT 'synthetic/textbook_' || doc_id || '.md' AS path, 'About ' || md5(text) AS content, 'code_textbook' AS source, length(text) AS from_snippet_chars FROM documents WHERE length(text) >= 120 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "ingest_limited": _INGESTED + """, y AS (SELECT *, coalesce(sum((status = 'yielded')::INT) OVER (PARTITION BY repo_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got FROM st),
z AS (SELECT status FROM y WHERE got < 20) SELECT status, count(*) AS n FROM z GROUP BY ALL UNION ALL SELECT 'seen', count(*) FROM z""",
    "educational_examples": "SELECT doc_id AS ord, 'Study this snippet and write a well-documented solution:' || chr(10) || 'def f' || doc_id || '(x):' || chr(10) || '    # ' || md5(text) || chr(10) || '    return x' || chr(10) AS instruction, 0.8::DOUBLE AS seed_quality FROM documents",
}
