"""DuckDB SQL for the queries that SQL can express."""

from .license import DRIFT, GRAM, PASSAGES, SHARE, _templates

op10_quality_rules = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS gram
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY r),
ln AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(ln.dup, 0)::BIGINT AS n_dup_lines, coalesce(ln.n, 0) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR (2 * upper > letters AND letters >= 20) OR 2 * n_dup_lines > n_lines) AS kept
FROM f
"""

op5_winnowing = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS i
        FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT r, i, x.n, w.item_id
  FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n) x
  JOIN win w ON w.n = x.n AND w.gram = array_to_string(x.ws[i:i + x.n - 1], ' ')),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
it AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN it USING (r)
"""

op1_chat_formatting = r"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g') AS erole,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g') AS etext
  FROM a)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(erole) + length(etext) + 20)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_PASSAGES = ",\n".join(f"({i}, '{t.label}', '{' '.join(t.words)}', {list(t.must)}::INT[])" for i, t in enumerate(_templates({}, PASSAGES)))
op8_license_scan = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p(phrase, n, label) AS (VALUES ('mit license', 2, 'mit'), ('apache license', 2, 'apache'), ('general public license', 3, 'gpl')),
pl AS (SELECT r, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 1),
base AS (SELECT r, i - 1 AS w, label FROM pl, p WHERE array_to_string(ws[i:i + n - 1], ' ') = phrase),
b AS (
  SELECT r, count(*) AS n_base, min(w) AS f, max(w) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM base GROUP BY r),
t(template, label, words, must) AS (VALUES
""" + _PASSAGES + rf"""),
tp AS (
  SELECT template, j - 1 AS t_at, array_to_string(x[j:j + {GRAM - 1}], ' ') AS gram
  FROM (SELECT template, x, unnest(generate_series(1, len(x) - {GRAM - 1})) AS j FROM (SELECT template, string_split(words, ' ') AS x FROM t))),
hit AS (
  SELECT DISTINCT r, template, t_at, i - 1 - t_at AS diagonal
  FROM pl JOIN tp ON i + {GRAM - 1} <= len(ws) AND array_to_string(ws[i:i + {GRAM - 1}], ' ') = gram),
-- for each diagonal the template words that hits on it or up to {DRIFT} further cover
cw AS (
  SELECT a.r, a.template, a.diagonal, count(DISTINCT b.t_at + s) AS covered, list(DISTINCT b.t_at) AS ts
  FROM (SELECT DISTINCT r, template, diagonal FROM hit) a
  JOIN hit b ON b.r = a.r AND b.template = a.template AND b.diagonal BETWEEN a.diagonal AND a.diagonal + {DRIFT},
  generate_series(0, {GRAM - 1}) g(s) GROUP BY ALL),
v AS (
  SELECT r, label, covered / len(string_split(words, ' '))::DOUBLE AS share
  FROM cw JOIN t USING (template) WHERE list_has_all(ts, must)),
m AS (SELECT r, label, share FROM v WHERE share >= {SHARE} UNION ALL SELECT r, label, 1.0 FROM base),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l_.l::BIGINT AS last_word,
       coalesce(l_.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0)::DOUBLE AS score
FROM d LEFT JOIN b l_ USING (r) LEFT JOIN l USING (r)
"""

op6_suffix_array_dedup = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT r, i, substr(x, 2 * i + 1, 400) AS s
  FROM (SELECT r, x, unnest(generate_series(0, length(x) // 2 - 200)) AS i FROM d WHERE length(x) >= 400)),
h AS (SELECT r, i, md5_number(s) AS k FROM w),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
-- runs of covered bytes: a window opens a new one if it starts after the end of all before it
m AS (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 200, -1))::INT AS new FROM hit),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
span AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
cut AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY run), 0) AS p FROM span),
kept AS (
  SELECT c.r, sum(b - a) AS n, count(*) AS spans, max(b) AS last,
         string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY run) AS y
  FROM cut c JOIN d USING (r) GROUP BY c.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE y || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

op9_ngram_jaccard = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pr JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node WHERE link.y > reach.root)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(root))::BIGINT AS component_id
FROM d JOIN reach ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
