"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS span
  FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35
),
again AS (SELECT span FROM win GROUP BY span HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win JOIN again USING (span)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 35) AS r(k)),
word AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""

MEASURES = rf"""
d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS span FROM d, unnest(range(1, len(w) - 1)) AS x(i) WHERE len(w) >= 3
),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, span) AS n FROM win) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n FROM twice GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
measures AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_lines,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
broken AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)::INT AS a, (10 * n_symbols > n_words)::INT AS b,
    (10 * n_dup_lines > 3 * n_lines)::INT AS c FROM measures
),
rates AS (SELECT source, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM broken GROUP BY source),
long_rates AS (UNPIVOT rates ON a, b, c INTO NAME rule VALUE rate),
priors AS (
  SELECT rule, avg(rate) AS m, CASE WHEN var_pop(rate) > 0 AND avg(rate) * (1 - avg(rate)) / var_pop(rate) > 1
    THEN avg(rate) * (1 - avg(rate)) / var_pop(rate) - 1 ELSE 1 END AS weight FROM long_rates GROUP BY rule
),
refused AS (
  SELECT source, max((rate * n + m * weight) / (n + weight)) > 0.5 AS refused FROM long_rates JOIN priors USING (rule) GROUP BY source
)"""

OP8 = f"""
WITH {MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a = 1 AS base_failed, a = 0 AND NOT refused AS kept
FROM broken JOIN refused ON broken.source IS NOT DISTINCT FROM refused.source
"""

#: Bigram models of the labelled and of all texts over all words, each backed by its word model; an empty word starts a text.
OP9 = rf"""
WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w, doc_id IN (SELECT doc_id FROM good) AS t FROM documents
),
token AS MATERIALIZED (
  SELECT doc_id, t, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS prev FROM d, unnest(range(1, len(w) + 1)) AS x(i)
),
word AS (SELECT word, count(*) AS e, count(*) FILTER (t) AS g FROM token GROUP BY word),
pair AS (SELECT prev, word, count(*) AS e, count(*) FILTER (t) AS g FROM token GROUP BY prev, word),
history AS (SELECT prev, count(*) AS e, count(*) FILTER (t) AS g FROM token GROUP BY prev),
total AS (SELECT count(*) AS e, count(*) FILTER (t) AS g, count(DISTINCT word) + 2 AS slots FROM token),
loss AS (
  SELECT doc_id, count(*) AS n,
    -avg(log2((p.g + 100.0::DOUBLE * (o.g + 1) / (total.g + slots)) / (h.g + 100.0::DOUBLE))) AS a,
    -avg(log2((p.e + 100.0::DOUBLE * (o.e + 1) / (total.e + slots)) / (h.e + 100.0::DOUBLE))) AS b
  FROM token JOIN pair p USING (prev, word) JOIN word o USING (word) JOIN history h USING (prev), total GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(coalesce(a, 0), 6) AS target_loss, round(coalesce(b, 0), 6) AS background_loss,
  round(coalesce(a - b, 0), 6) AS difference
FROM d LEFT JOIN loss USING (doc_id)
"""

#: Full sets of two-word shingles, all pairs that share one, and everything that can be reached along links.
OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d
),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM common c JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)
),
edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN edge ON r = x)
SELECT doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""

#: Shares in billionths; their products have 128 bits.
OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
word AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(cnt.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 1)) // (coalesce(t.n, 0) + size.v) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 1)) // (size.n + size.v) AS q
  FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN cnt USING (lang, source, term)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY lang, source) t ON t.lang = grp.lang AND t.source = grp.source
),
pair AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
),
every AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR rank <= 200
"""

QUERIES = {"op1_substring_dedup": OP1, "op6_exact_dedup": OP6, "op8_quality_rules": OP8, "op9_lm_scores": OP9, "op10_near_dedup": OP10, "op12_divergence_audit": OP12}
