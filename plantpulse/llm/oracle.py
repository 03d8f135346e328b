"""The queries that SQL can express, written again for DuckDB."""

from __future__ import annotations

from plantpulse.llm.quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

#: Words of every document with their places, and each document's list of words.
_WORDS = r"""
lists AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents)"""

SQL: dict[str, str] = {}

SQL["op4_quality_rules"] = rf"""
WITH {_WORDS},
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM lists),
windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM lists WHERE len(w) >= 3)),
again AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(list_aggregate(w, 'string_agg', ''))::BIGINT AS chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM lists JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.3 AND n_shouts / n_words <= 0.3
         AND n_stop_words / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM j"""

SQL["op5_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, range(10) t(k) WHERE k < n GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

SQL["op1_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(35) t(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

SQL["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(3, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM i JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

SQL["op8_lm_scoring"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (
  SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a, CASE WHEN i > 2 THEN w[i - 2] END AS z, least(i, 3) AS most
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (
  SELECT doc_id, i, most,
         count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
         count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY doc_id, b) AS c1,
         count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY doc_id, a, b) AS c2,
         count(*) OVER (PARTITION BY z, a, b) - count(*) OVER (PARTITION BY doc_id, z, a, b) AS c3
  FROM u),
h AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS h1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM c),
s AS (
  SELECT doc_id, sum(CASE
    WHEN i > 2 AND c3 > 0 THEN ln(c3 / h2)
    WHEN i > 1 AND c2 > 0 THEN (most - 2) * ln(0.4::DOUBLE) + ln(c2 / h1)
    WHEN c1 > 0 THEN (most - 1) * ln(0.4::DOUBLE) + ln(c1 / n)
    ELSE (most - 1) * ln(0.4::DOUBLE) - ln(n + 1) END) AS s
  FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0), 3) AS log_score FROM d LEFT JOIN s USING (doc_id)"""

SQL["op3_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([<\[]\\*)(/?s>|\|turn\|>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>)',
                           '\1\\\2', 'g') AS body FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(role) + 1 + length(body) + length('</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

SQL["op12_merkle_manifest"] = r"""
WITH RECURSIVE rows_ AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS g, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, g, leaf, shown, tampered, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM (SELECT doc_id, g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
               sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS shown,
               xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 7 = 0 AS tampered
        FROM rows_)),
tree AS (
  SELECT g, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT * FROM (
    SELECT g, level + 1 AS level, idx // 2 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, (any_value(n) + 1) // 2 AS n
    FROM tree WHERE n > 1 GROUP BY g, level, idx // 2)),
nodes AS MATERIALIZED (SELECT * FROM tree),
subroots AS MATERIALIZED (SELECT g, h AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS idx FROM nodes WHERE n = 1),
over_ AS (
  SELECT 0 AS level, idx, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT * FROM (
    SELECT level + 1 AS level, idx // 2 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, (any_value(n) + 1) // 2 AS n
    FROM over_ WHERE n > 1 GROUP BY level, idx // 2)),
top AS MATERIALIZED (SELECT * FROM over_),
steps AS MATERIALIZED (
  SELECT l.g, l.idx AS leaf_idx, x.level, l.idx // (1 << x.level) % 2 AS is_right, coalesce(s.h, '') AS h
  FROM leaves l JOIN (SELECT DISTINCT g, level FROM nodes WHERE n > 1) x USING (g)
  LEFT JOIN nodes s ON s.g = l.g AND s.level = x.level AND s.idx = xor(l.idx // (1 << x.level), 1)
  UNION ALL
  SELECT l.g, l.idx, r.height + x.level, r.idx // (1 << x.level) % 2, coalesce(s.h, '')
  FROM leaves l JOIN subroots r USING (g) CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) x
  LEFT JOIN top s ON s.level = x.level AND s.idx = xor(r.idx // (1 << x.level), 1)),
folded AS (
  SELECT g, idx, 0 AS level, CASE WHEN tampered THEN shown ELSE leaf END AS h FROM leaves
  UNION ALL
  SELECT f.g, f.idx, f.level + 1, sha256(CASE WHEN s.is_right = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM folded f JOIN steps s ON s.g = f.g AND s.leaf_idx = f.idx AND s.level = f.level),
ends AS (SELECT g, idx, arg_max(h, level) AS folded_root FROM folded GROUP BY ALL),
proofs AS (SELECT g, leaf_idx AS idx, sha256(string_agg(h, '' ORDER BY level)) AS proof FROM steps GROUP BY ALL)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaves JOIN subroots USING (g) JOIN ends ON ends.g = leaves.g AND ends.idx = leaves.idx
LEFT JOIN proofs ON proofs.g = leaves.g AND proofs.idx = leaves.idx"""

SQL["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS MATERIALIZED (
  SELECT lang, p, count(*) AS f FROM (
    SELECT lang, w[i:i + m - 1] AS p
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) t(m) WHERE len(w) >= m))
  GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, p, f AS a, len(p) AS m FROM f WHERE len(p) > 1),
cuts AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p[i:i + s - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, s, unnest(range(1, m - s + 2)) AS i FROM c, range(2, 4) t(s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT low.*, array_to_string(p, ' ') AS phrase FROM low LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
