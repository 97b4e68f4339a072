"""SQL twins, written for DuckDB with their own literals."""

STOP = ("the of and to in is that for it was on are as with be this by from or an der die das und ist von zu mit den "
        "für auf im nicht ein eine le la les de des et est un une que qui dans pour sur au avec el los las y en es del "
        "se por con no una su para al").split()

OP8 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
), again AS (
  SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) AS r(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(body, '!')) AS n_excl,
         len(list_filter(words, lambda x: x IN ({", ".join(f"'{s}', '{s.capitalize()}'" for s in STOP)}))) AS n_stop,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_dots
  FROM d LEFT JOIN covered c USING (doc_id)
), v AS (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars * 100 BETWEEN n_words * 200 AND n_words * 1200 AND n_symbols * 100 <= n_words * 25
         AND n_excl * 100 <= n_words * 75 AND n_stop * 100 >= n_words * 6 AND n_dup_lines * 100 <= n_lines * 40
         AND n_bullet * 100 <= n_lines * 90 AND n_dots * 100 <= n_lines * 30 AS kept
FROM v
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reached.doc_id, edges.b FROM reached JOIN edges ON edges.a = reached.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

OP3 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), least_doc AS (
  SELECT w, min(doc_id) AS m FROM win GROUP BY w
), hit AS (
  SELECT doc_id, i FROM win JOIN least_doc USING (w) WHERE doc_id > m
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hit
), numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked
), spans AS (
  SELECT doc_id, g, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY doc_id, g
), pieces AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans
), cut AS (
  SELECT p.doc_id, string_agg(substr(d.h, 2 * p.before + 1, 2 * (p.s - p.before)), '' ORDER BY p.s) AS head,
         max(p.e) AS last, sum(p.e - p.s) AS removed, count(*) AS spans
  FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(c.head, '') || substr(d.h, 2 * coalesce(c.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""

OP11 = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), shared AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.*, shared.key IS NOT NULL AND l.doc_id > shared.first AS lost FROM l LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _op12() -> str:
    assigned = """
a{k} AS (
  SELECT p.vec_id, p.part, p.c, min(struct_pack(d := list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i]))), e := b.entry)) AS best
  FROM p JOIN b{k} b USING (part) GROUP BY p.vec_id, p.part, p.c
)"""
    replaced = """
s{k} AS (
  SELECT part, entry, list(floor(total::DOUBLE / n)::BIGINT ORDER BY i) AS c
  FROM (SELECT part, best.e AS entry, i, sum(c[i]) AS total, count(*) AS n FROM a{j}, range(1, 65536) AS r(i) WHERE i <= len(c) GROUP BY ALL)
  GROUP BY part, entry
), b{k} AS (
  SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM b{j} b LEFT JOIN s{k} s USING (part, entry)
)"""
    steps = ",".join(replaced.format(k=k, j=k - 1) + "," + assigned.format(k=k) for k in (1, 2))
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, part, c[part * len(c) // 16 + 1 : (part + 1) * len(c) // 16] AS c FROM (SELECT vec_id, c, unnest(range(16)) AS part FROM v)
), b0 AS (
  SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::BIGINT AS entry, c
  FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
),{assigned.format(k=0)},{steps}
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)
"""


OP12 = _op12()

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, k.c AS lang_c
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), totals AS (
  SELECT *, sum(c) OVER g AS n, sum(lang_c) OVER g AS lang_n, count(*) OVER g AS v FROM full_counts WINDOW g AS (PARTITION BY lang, source)
), p AS (
  SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_c + 5)) // (lang_n + 5 * v) AS q
  FROM totals
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
