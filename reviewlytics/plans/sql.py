"""The same definitions as SQL text, for checking in another engine."""

from __future__ import annotations

import re

from reviewlytics.config import MAX_FEATURES, NEGATION_CUES, PROBES, SEED
from reviewlytics.functions.text import CLITIC_RULES, JOINED_WORDS, stop_words
from reviewlytics.plans.base import ALPHA, FOLDS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def word_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def unescape(e: str) -> str:
    """The entities the given texts hold, with or without their semicolon, by patterns of their own."""
    e = f"regexp_replace({e}, '&amp;?', chr(1), 'g')"
    for pattern, code in (("quot;?|&#34;|&#x22;", 34), ("#39;|&#x27;|&apos;", 39), ("lt;?|&#60;", 60), ("gt;?|&#62;", 62),
                          ("nbsp;?|&#160;", 160), ("copy;?|&#169;", 169), ("middot;?|&#183;", 183)):
        e = f"regexp_replace({e}, '&{pattern}', chr({code}), 'g')"
    return f"replace({e}, chr(1), '&')"


def strip_tags(e: str) -> str:
    return f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"


def squeeze(e: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz'":
        e = f"regexp_replace({e}, {lit(c + '{3,}')}, {lit(c + c)}, 'g')"
    return e


def clean(e: str) -> str:
    inner = squeeze(f"lower({strip_tags(unescape(e))})")
    return f"trim(regexp_replace({inner}, {lit(chr(91) + '^a-z' + chr(39) + ']+')}, ' ', 'g'))"


def tokenize(cleaned: str) -> str:
    e = f"(' ' || {cleaned} || ' ')"
    for pattern, replacement in CLITIC_RULES:
        e = f"regexp_replace({e}, {lit(pattern)}, {lit(replacement.replace('$', chr(92)))}, 'g')"
    for a, b in JOINED_WORDS:
        pattern, split = f"\\b({a})({b})\\b", "\\1 \\2"
        e = f"regexp_replace({e}, {lit(pattern)}, {lit(split)}, 'g')"
    return f"list_filter(string_split_regex(trim({e}), ' +'), lambda w: w <> '')"


def bare(t: str) -> str:
    return f"regexp_replace({t}, '_NEG$', '')"


def long_enough(tokens: str, n: int = 2) -> str:
    return f"list_filter({tokens}, lambda t: length({bare('t')}) >= {n})"


def without_stops(tokens: str, keep_negations: bool) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({word_list(stop_words(keep_negations))}, {bare('t')}))"


def negated(tokens: str, scope: int = 3) -> str:
    cue = f"(list_contains({word_list(NEGATION_CUES)}, c) OR c LIKE '%n''t')"
    return (
        f"list_transform({tokens}, lambda t, i: CASE WHEN len(list_filter("
        f"list_slice({tokens}, greatest(i - {scope}, 1), i - 1), lambda c: {cue})) > 0 "
        f"THEN t || '_NEG' ELSE t END)"
    )


def recipe_tokens(e: str, keep_negations=None, mark=False, min_length: int = 2) -> str:
    """keep_negations None: stop words stay."""
    t = tokenize(clean(e))
    if mark:
        t = negated(t)
    t = long_enough(t, min_length)
    if keep_negations is not None:
        t = without_stops(t, keep_negations)
    return t


def word_count(e: str) -> str:
    return f"len(list_filter(string_split_regex({e}, '\\s+'), lambda w: w <> ''))"


def rounded(body: str, *columns: str, digits: int = 6) -> str:
    fixed = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({fixed}) FROM ({body})"


def md5(seed, *keys: str) -> str:
    return "md5(" + " || ':' || ".join([lit(str(seed))] + [f"CAST({k} AS VARCHAR)" for k in keys]) + ")"


def hash_number(digest: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 8) AS BIGINT)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n"


REVIEWS = """reviews AS MATERIALIZED (
  SELECT d.doc_id, d.text, l.quality AS label, d.source AS film_id, d.lang AS corpus
  FROM documents d JOIN labels l USING (doc_id))"""

LABELLED = "labelled AS (SELECT doc_id, quality AS label FROM labels)"

TOKENS = f"""review_tokens AS MATERIALIZED (
  SELECT doc_id, film_id, corpus, label, {recipe_tokens('text')} AS tokens FROM reviews)"""


def folds(k: int = FOLDS) -> str:
    return f"""folds AS MATERIALIZED (
  SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {md5(SEED, 'doc_id')}, doc_id) - 1)
    % {k} AS INTEGER) AS fold FROM labelled)"""


def term_rows(name: str, source: str, keep: str, n_max: int = 2) -> str:
    """CTE of ``keep, term, tf`` from a relation with ``keep`` and tokens."""
    grams = "tokens"
    if n_max == 2:
        grams = "list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))"
    return f"""{name} AS MATERIALIZED (
  SELECT {keep}, term, count(*) AS tf FROM (SELECT {keep}, unnest({grams}) AS term FROM {source}) GROUP BY ALL)"""


def tf_weight(kind: str) -> str:
    return {"sublinear": "(1.0 + ln(CAST(tf AS DOUBLE)))", "binary": "CAST(1.0 AS DOUBLE)", "raw": "CAST(tf AS DOUBLE)"}[kind]


def tfidf(p: str, source: str, keys: str = "fit", n_max: int = 2, tf: str = "sublinear", idf: bool = True,
          cap: int = MAX_FEATURES) -> str:
    """CTEs {p}_terms, {p}_sizes, {p}_vocab, {p}_weighted from keys, doc_id, label, tokens."""
    rank = "df" if tf == "binary" else "cf"
    idf_sql = "ln((1.0 + n_docs) / (1.0 + df)) + 1.0" if idf else "CAST(1.0 AS DOUBLE)"
    return f"""{term_rows(p + '_terms', source, f'{keys}, doc_id, label', n_max)},
{p}_sizes AS MATERIALIZED (
  SELECT {keys}, CAST(count(*) AS DOUBLE) AS n_docs, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS n_pos,
    CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n_neg FROM {source} GROUP BY {keys}),
{p}_vocab AS MATERIALIZED (
  SELECT {keys}, term, df, cf, {idf_sql} AS idf FROM (
    SELECT {keys}, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {p}_terms GROUP BY {keys}, term
    HAVING count(*) >= 2
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {rank} DESC, term) <= {cap}
  ) JOIN {p}_sizes USING ({keys})),
{p}_weighted AS MATERIALIZED (
  SELECT {keys}, doc_id, label, term, tf, idf,
    {tf_weight(tf)} * idf / sqrt(sum(({tf_weight(tf)} * idf) ** 2) OVER (PARTITION BY {keys}, doc_id)) AS weight
  FROM {p}_terms JOIN {p}_vocab USING ({keys}, term))"""


def class_sums(p: str, keys: str = "fit") -> str:
    return f"""{p}_sums AS MATERIALIZED (
  SELECT {keys}, term, first(idf) AS idf, sum(CASE WHEN label = 1 THEN weight ELSE 0.0 END) AS pos_sum,
    sum(CASE WHEN label = 0 THEN weight ELSE 0.0 END) AS neg_sum FROM {p}_weighted GROUP BY {keys}, term)"""


def naive_bayes(p: str, source: str, keys: str = "fit", alpha: str = str(ALPHA), n_max: int = 2) -> str:
    """CTEs ending in {p}_weights and {p}_bias; alpha may be a column of {p}_alphas."""
    grid = alpha == "alpha"
    out = f"{keys}, alpha" if grid else keys
    cross = f", {p}_alphas" if grid else ""
    return f"""{tfidf(p, source, keys, n_max)},
{class_sums(p, keys)},
{p}_totals AS MATERIALIZED (
  SELECT {keys}, sum(pos_sum) AS sp, sum(neg_sum) AS sq, count(*) AS v FROM {p}_sums GROUP BY {keys}),
{p}_weights AS MATERIALIZED (
  SELECT {out}, term, idf, ln((pos_sum + {alpha}) / (sp + {alpha} * v)) - ln((neg_sum + {alpha}) / (sq + {alpha} * v)) AS weight
  FROM {p}_sums JOIN {p}_totals USING ({keys}){cross}),
{p}_bias AS MATERIALIZED (SELECT {out}, CASE WHEN n_neg = 0 THEN 500.0 WHEN n_pos = 0 THEN -500.0
  ELSE ln(n_pos / n_neg) END AS bias FROM {p}_sizes{cross})"""


def scored(name: str, p: str, source: str, keep: str, keys: str = "fit", model_keys: str | None = None,
           n_max: int = 2, tf: str = "sublinear") -> str:
    """CTE ``name``: model keys, doc_id, keep, score, pred."""
    mk = model_keys or keys
    w = f"({tf_weight(tf)} * idf)"
    return f"""{term_rows(name + '_terms', source, f'{keys}, doc_id', n_max)},
{name}_sums AS MATERIALIZED (
  SELECT {mk}, doc_id, sum({w} * weight) / sqrt(sum({w} ** 2)) AS m
  FROM {name}_terms JOIN {p}_weights USING ({keys}, term) GROUP BY {mk}, doc_id),
{name} AS MATERIALIZED (
  SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM (
    SELECT {mk}, doc_id, {keep}, round(1.0 / (1.0 + exp(-(bias + coalesce(m, 0.0)))), 9) AS score
    FROM {source} JOIN {p}_bias USING ({keys}) LEFT JOIN {name}_sums USING ({mk}, doc_id)))"""


FOLDED = f"""{folds()},
folded AS MATERIALIZED (
  SELECT t.*, fold, fold AS fit FROM review_tokens t JOIN folds USING (doc_id)),
fold_train AS MATERIALIZED (
  SELECT f.fit, t.doc_id, t.label, t.tokens FROM folded t, (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fit) f
  WHERE t.fold <> f.fit)"""

OUT_OF_FOLD = ",\n".join([
    REVIEWS, LABELLED, TOKENS, FOLDED, naive_bayes("nb", "fold_train"),
    scored("oof", "nb", "folded", "film_id, corpus, label"),
    "scored AS MATERIALIZED (SELECT doc_id, film_id, corpus, label, score, pred FROM oof)",
])

ONE_FIT = "one_fit AS MATERIALIZED (SELECT 'all' AS fit, doc_id, film_id, corpus, label, tokens FROM review_tokens)"
FULL_MODEL = ",\n".join([REVIEWS, TOKENS, ONE_FIT, naive_bayes("nb", "one_fit")])


def probe(pattern: str, text: str = "text") -> str:
    """A probe with its word boundaries written out for Unicode letters."""
    other = "[^\\p{L}\\p{N}_]"
    opening = re.sub(r"\\b(?=[a-z(])", lambda _: f"(?:^|{other})", pattern)
    both = opening.replace("\\b", f"(?:$|{other})")
    return f"regexp_matches({text}, {lit('(?i)' + both)})"


PROBE_FLAGS = {name: probe(pattern) for name, pattern in PROBES}


def share_interval(name: str, source: str, keys: str) -> str:
    """CTE ``name``: keys, n, hits, ci_low, ci_high from keys, n, hits."""
    return f"""{name}_k AS (SELECT {keys}, n, hits, CAST(hits AS DOUBLE) / n AS p, unnest(range(0, n + 1)) AS k FROM {source}),
{name}_cdf AS (SELECT {keys}, n, hits, k, sum(CASE
    WHEN hits = 0 THEN CAST(k = 0 AS INTEGER) WHEN hits = n THEN CAST(k = n AS INTEGER)
    ELSE exp(lgamma(n + 1) - CASE WHEN k = 0 THEN 0.0 ELSE lgamma(k + 1) END
      - CASE WHEN n = k THEN 0.0 ELSE lgamma(n - k + 1) END + k * ln(p) + (n - k) * ln(1.0 - p)) END)
    OVER (PARTITION BY {keys}, n, hits ORDER BY k) AS cdf
  FROM {name}_k),
{name} AS MATERIALIZED (SELECT {keys}, n, hits, CAST(min(k) FILTER (cdf >= 0.025 - 1e-12) AS DOUBLE) / n AS ci_low,
    CAST(min(k) FILTER (cdf >= 0.975 - 1e-12) AS DOUBLE) / n AS ci_high FROM {name}_cdf GROUP BY {keys}, n, hits)"""


def mcnemar_p(n01: str, n10: str) -> str:
    n, low = f"({n01} + {n10})", f"least({n01}, {n10})"
    return (
        f"CASE WHEN {n01} = {n10} THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(0, {low} + 1), "
        f"lambda i: exp(lgamma({n} + 1) - CASE WHEN i = 0 THEN 0.0 ELSE lgamma(i + 1) END "
        f"- lgamma({n} - i + 1) - {n} * ln(2.0))))) END"
    )


def trimmed(scores: str) -> str:
    """Mean between the order statistics at the 10% and 90% quantiles, from a sorted list."""
    n = f"len({scores})"
    low, high = f"{scores}[(({n} - 1) * 10 + 99) // 100 + 1]", f"{scores}[(({n} - 1) * 90) // 100 + 1]"
    return (
        f"CASE WHEN {n} < 5 THEN list_avg({scores}) ELSE "
        f"list_avg(list_filter({scores}, lambda x: x >= {low} AND x <= {high})) END"
    )


def rules(name: str, source: str, keys: str) -> str:
    """CTE ``name``: keys and the score of each rule from keys, score."""
    return f"""{name} AS MATERIALIZED (SELECT {keys}, list_avg(list_transform(s, lambda x: CASE WHEN x >= 0.5 THEN 1.0 ELSE 0.0 END)) AS majority,
    list_avg(s) AS mean_probability, {trimmed('s')} AS trimmed_mean
  FROM (SELECT {keys}, list_sort(list(score)) AS s FROM {source} GROUP BY {keys}))"""


def compare_rules(source: str, n_boot: int) -> str:
    """CTE verdicts: film_id, method and the verdict of each rule."""
    ends = ", ".join(
        f"quantile_cont({r}, {q}) AS {r}_{end}"
        for r in ("majority", "mean_probability", "trimmed_mean") for end, q in (("low", 0.025), ("high", 0.975))
    )
    stacked = " UNION ALL ".join(
        f"SELECT film_id, '{r}' AS method, n_reviews, {r} AS score, {r}_low AS ci_low, {r}_high AS ci_high, "
        f"share_positive, polarisation FROM moments JOIN points USING (film_id) JOIN ranges USING (film_id)"
        for r in ("majority", "mean_probability", "trimmed_mean")
    )
    return f"""numbered AS MATERIALIZED (
  SELECT film_id, doc_id, score, row_number() OVER (PARTITION BY film_id ORDER BY {md5(SEED, 'doc_id')}, doc_id) AS number,
    count(*) OVER (PARTITION BY film_id) AS n FROM {source}),
picks AS MATERIALIZED (
  SELECT film_id, draw, {hash_number(md5(SEED, 'film_id', 'draw', 'doc_id'))} % n + 1 AS number
  FROM numbered, (SELECT unnest(range(1, {n_boot} + 1)) AS draw)),
resampled AS MATERIALIZED (SELECT p.film_id, p.draw, q.score FROM picks p JOIN numbered q USING (film_id, number)),
{rules('resampled_rules', 'resampled', 'film_id, draw')},
ranges AS MATERIALIZED (SELECT film_id, {ends} FROM resampled_rules GROUP BY film_id),
{rules('points', source, 'film_id')},
moments AS MATERIALIZED (
  SELECT film_id, count(*) AS n_reviews, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS share_positive,
    stddev_pop(score) AS polarisation FROM {source} GROUP BY film_id),
verdicts AS MATERIALIZED (
  SELECT *, CASE WHEN score >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment,
    NOT (ci_low <= 0.5 AND ci_high >= 0.5) AS decisive FROM ({stacked}))"""


def majority_verdicts(source: str, film: str = "film_id") -> str:
    """CTE majority from film, score, with the binomial interval."""
    return f"""votes AS MATERIALIZED (
  SELECT {film}, count(*) AS n, count(*) FILTER (score >= 0.5) AS hits, stddev_pop(score) AS polarisation
  FROM {source} GROUP BY {film}),
{share_interval('vote_ci', 'votes', film)},
majority AS MATERIALIZED (
  SELECT {film}, 'majority' AS method, n AS n_reviews, CAST(hits AS DOUBLE) / n AS score, ci_low, ci_high,
    CAST(hits AS DOUBLE) / n AS share_positive, polarisation,
    CASE WHEN CAST(hits AS DOUBLE) / n >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment,
    NOT (ci_low <= 0.5 AND ci_high >= 0.5) AS decisive
  FROM votes JOIN vote_ci USING ({film}, n, hits))"""


# -- Porter stems in SQL, one CTE per step of the algorithm ------------------------------ #
# Suffixes of the published algorithm and its extensions, and words with an irregular stem.
_IRREGULAR = (
    ("sky", "sky"), ("skies", "sky"), ("dying", "die"), ("lying", "lie"), ("tying", "tie"), ("news", "news"),
    ("innings", "inning"), ("inning", "inning"), ("outings", "outing"), ("outing", "outing"), ("cannings", "canning"),
    ("canning", "canning"), ("howe", "howe"), ("proceed", "proceed"), ("exceed", "exceed"), ("succeed", "succeed"),
)
_LONG = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
_MIDDLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_ENDINGS = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou",
)


def _shape(e: str) -> str:
    """C for consonants and V for vowels; y takes the other kind of the letter before it, C at the start (runs of y up to a dozen)."""
    e = f"regexp_replace(translate({e}, 'aeioubcdfghjklmnpqrstvwxz', 'VVVVVCCCCCCCCCCCCCCCCCCCC'), '[^VCy]', 'C', 'g')"
    e = f"regexp_replace({e}, '^y', 'C')"
    for _ in range(6):
        e = f"replace(replace({e}, 'Cy', 'CV'), 'Vy', 'VC')"
    return e


def _cut(k: int, of: str = "w") -> str:
    return f"substr({of}, 1, length({of}) - {k})"


def _measured(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'V+C+'))"


def _short(word: str, shape: str) -> str:
    return f"(({shape} LIKE '%CVC' AND {word} NOT SIMILAR TO '.*[wxy]') OR {shape} = 'VC')"


def _ends(suffix: str) -> str:
    return f"ends_with(w, '{suffix}')"


def _swapped(table) -> str:
    cases = " ".join(
        f"WHEN {_ends(a)} THEN CASE WHEN {_measured(_cut(len(a), 's') + (' || ' + lit('C') if a == 'logi' else ''))} > 0 THEN {_cut(len(a))} || '{b}' ELSE w END"
        for a, b in table
    )
    return f"CASE {cases} ELSE w END"


def stems(name: str, words: str) -> str:
    """CTEs ending in ``name`` (word, stem) of a relation with distinct lower-case words."""
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _IRREGULAR)
    ready = f"(SELECT *, {_shape('w')} AS s FROM {{}})"
    repaired = f"""CASE WHEN stem SIMILAR TO '.*(at|bl|iz)' THEN stem || 'e'
      WHEN length(stem) > 1 AND right(stem, 1) = left(right(stem, 2), 1) AND t LIKE '%C' THEN
        CASE WHEN right(stem, 1) IN ('l', 's', 'z') THEN stem ELSE {_cut(1, 'stem')} END
      WHEN {_measured('t')} = 1 AND {_short('stem', 't')} THEN stem || 'e' ELSE stem END"""
    endings = " ".join(
        f"WHEN {_ends(a)} THEN CASE WHEN {_measured(_cut(len(a), 's'))} > 1"
        + (f" AND {_cut(3)} SIMILAR TO '.*[st]'" if a == "ion" else "") + f" THEN {_cut(len(a))} ELSE w END"
        for a in _ENDINGS
    )
    steps = [
        f"""CASE WHEN {_ends('ies')} THEN {_cut(2)} || CASE WHEN length(w) = 4 THEN 'e' ELSE '' END WHEN {_ends('sses')} THEN {_cut(2)}
      WHEN {_ends('s')} AND NOT {_ends('ss')} THEN {_cut(1)} ELSE w END""",
        None,
        f"CASE WHEN {_ends('y')} AND length(w) > 2 AND substr(s, length(w) - 1, 1) = 'C' THEN {_cut(1)} || 'i' ELSE w END",
        f"CASE WHEN {_ends('alli')} AND {_measured(_cut(4, 's'))} > 0 THEN {_cut(2)} ELSE w END",
        _swapped(_LONG),
        _swapped(_MIDDLE),
        f"CASE {endings} ELSE w END",
        f"CASE WHEN {_ends('e')} AND ({_measured(_cut(1, 's'))} > 1 OR ({_measured(_cut(1, 's'))} = 1 AND NOT {_short(_cut(1), _cut(1, 's'))})) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN {_ends('ll')} AND {_measured(_cut(1, 's'))} > 1 THEN {_cut(1)} ELSE w END",
    ]
    out, last = [], f"{name}_0"
    out.append(f"{last} AS MATERIALIZED (SELECT word, word AS w FROM {words} WHERE length(word) > 2)")
    for i, step in enumerate(steps, 1):
        now = f"{name}_{i}"
        if step is None:
            vowel = f"{_ends('ed')} AND {_cut(2, 's')} LIKE '%V%'", f"{_ends('ing')} AND {_cut(3, 's')} LIKE '%V%'"
            out.append(f"""{now}_cut AS MATERIALIZED (SELECT word, w, s, CASE WHEN {_ends('ied')} OR {_ends('eed')} THEN NULL
      WHEN {vowel[0]} THEN {_cut(2)} WHEN {vowel[1]} THEN {_cut(3)} END AS stem FROM {ready.format(last)})""")
            step = f"""CASE WHEN {_ends('ied')} THEN {_cut(2)} || CASE WHEN length(w) = 4 THEN 'e' ELSE '' END
      WHEN {_ends('eed')} THEN CASE WHEN {_measured(_cut(3, 's'))} > 0 THEN {_cut(1)} ELSE w END WHEN stem IS NULL THEN w ELSE {repaired} END"""
            out.append(f"{now} AS MATERIALIZED (SELECT word, {step} AS w FROM (SELECT *, left(s, length(stem)) AS t FROM {now}_cut))")
        else:
            out.append(f"{now} AS MATERIALIZED (SELECT word, {step} AS w FROM {ready.format(last)})")
        last = now
    out.append(
        f"{name} AS MATERIALIZED (SELECT word, CASE word {irregular} ELSE coalesce(w, word) END AS stem FROM {words} LEFT JOIN {last} USING (word))"
    )
    return ",\n".join(out)


def mapped(name: str, source: str, table: str, surface: str, value: str, keys: str = "doc_id") -> str:
    """CTE of ``source`` (keys, tokens) with tokens replaced by those of a table; negation marks stay."""
    return f"""{name} AS MATERIALIZED (
  SELECT {keys}, coalesce(n.tokens, []) AS tokens FROM {source} LEFT JOIN (
    SELECT doc_id, list(coalesce({value}, {bare('token')}) || CASE WHEN token LIKE '%\\_NEG' ESCAPE '\\' THEN '_NEG' ELSE '' END ORDER BY pos) AS tokens
    FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {source})
      LEFT JOIN {table} ON {surface} = {bare('token')} GROUP BY doc_id) n USING (doc_id))"""
