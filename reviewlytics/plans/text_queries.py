"""Text, feature and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlytics.config import EXTENDED_PROBES, PROBES, SEED
from reviewlytics.functions import text as tx
from reviewlytics.functions.arrow import stem_tokens, unescape_html_fully
from reviewlytics.operators import features as feat
from reviewlytics.operators import sampling
from reviewlytics.operators.normalise import DEFAULT, RECIPES, Recipe, joined_text, normalise
from reviewlytics.plans import sql as s
from reviewlytics.plans.base import (
    curve_draws, curve_plan_sql,
    Registry, derived_lemmas, documents, labelled, model_columns, one_fit, review_tokens, reviews,
)
from reviewlytics.runtime import settle, table

registry = Registry()
add = registry.add


# -- cleaning and tokens ----------------------------------------------------- #
@add("html_unescape", f"SELECT page_id, {s.unescape('html')} AS html FROM pages")
def _(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", tx.unescape_html(F.col("html")).alias("html"))


# The texts hold these four entities, some of them unterminated.
_FULL = "regexp_replace(html, '&amp;?', chr(1), 'g')"
for _name, _char in (("quot", '"'), ("middot", "·"), ("copy", "©")):
    _FULL = f"regexp_replace({_FULL}, '&{_name};?', '{_char}', 'g')"


@add("html_unescape_full", f"SELECT page_id, replace({_FULL}, chr(1), '&') AS html FROM pages")
def _(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", unescape_html_fully(F.col("html")).alias("html"))


@add("strip_tags", f"SELECT page_id, {s.strip_tags('html')} AS text FROM pages")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@add("clean_pages", f"SELECT page_id, {s.clean('html')} AS cleaned FROM pages")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.clean_text(F.col("html")).alias("cleaned"))


@add("clean_documents", f"SELECT doc_id, {s.clean('text')} AS cleaned FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@add("tokens", f"SELECT doc_id, array_to_string({s.tokenize(s.clean('text'))}, '|') AS tokens FROM documents")
def _(spark, folder):
    tokens = tx.tokenize(tx.clean_text(F.col("text")))
    return documents(spark, folder).select("doc_id", F.array_join(tokens, "|").alias("tokens"))


@add(
    "negation_scope",
    f"WITH t AS MATERIALIZED (SELECT doc_id, {s.tokenize(s.clean('text'))} AS tokens FROM documents) "
    f"SELECT doc_id, array_to_string({s.negated('tokens')}, ' ') AS marked FROM t",
)
def _(spark, folder):
    marked = tx.mark_negation(tx.tokenize(tx.clean_text(F.col("text"))))
    return documents(spark, folder).select("doc_id", joined_text(marked).alias("marked"))


@add(
    "stop_word_shares",
    f"""WITH t AS MATERIALIZED (SELECT doc_id, {s.tokenize(s.clean('text'))} AS tokens FROM documents)
    SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens,
      CAST(len({s.without_stops('tokens', False)}) AS INTEGER) AS kept_naive,
      CAST(len({s.without_stops('tokens', True)}) AS INTEGER) AS kept_aware FROM t""",
)
def _(spark, folder):
    docs = documents(spark, folder)
    tokens = docs.select("doc_id", tx.tokenize(tx.clean_text(F.col("text"))).alias("t"))
    t = F.col("t")
    return tokens.select(
        "doc_id", F.size(t).alias("n_tokens"), F.size(tx.drop_stop_words(t, False)).alias("kept_naive"),
        F.size(tx.drop_stop_words(t, True)).alias("kept_aware"),
    )


@add("stop_list_in_text", f"""
    WITH w AS (SELECT unnest({s.tokenize(s.clean('text'))}) AS word FROM documents)
    SELECT word, count(*) AS n, list_contains({s.word_list(tx.stop_words(True))}, word) AS in_aware_list
    FROM w WHERE list_contains({s.word_list(tx.stop_words(False))}, word) GROUP BY word""")
def _(spark, folder):
    docs = documents(spark, folder)
    words = docs.select(F.explode(tx.tokenize(tx.clean_text(F.col("text")))).alias("word"))
    listed = words.filter(F.col("word").isin(*tx.stop_words(False)))
    return listed.groupBy("word").agg(F.count("*").alias("n")).withColumn(
        "in_aware_list", F.col("word").isin(*tx.stop_words(True))
    )


@add("min_token_length", f"SELECT doc_id, array_to_string({s.recipe_tokens('text', min_length=4)}, ' ') AS kept FROM documents")
def _(spark, folder):
    kept = tx.drop_short(tx.tokenize(tx.clean_text(F.col("text"))), 4)
    return documents(spark, folder).select("doc_id", joined_text(kept).alias("kept"))


@add("normalised_negation_aware", s.with_(
    f"t AS MATERIALIZED (SELECT doc_id, {s.tokenize(s.clean('text'))} AS tokens FROM documents)",
    f"n AS MATERIALIZED (SELECT doc_id, {s.negated('tokens')} AS tokens FROM t)",
    f"l AS MATERIALIZED (SELECT doc_id, {s.long_enough('tokens')} AS tokens FROM n)",
) + f"SELECT doc_id, array_to_string({s.without_stops('tokens', True)}, ' ') AS text FROM l")
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    recipe = Recipe(normalisation="none", negation_marking=True)
    return normalise(docs, recipe).select("doc_id", joined_text().alias("text"))


STEM_CTES = f"""words AS MATERIALIZED (
  SELECT DISTINCT unnest({s.tokenize(s.clean('text'))}) AS word FROM documents),
{s.stems('stems', 'words')}"""


@add("stemmed_tokens", s.with_(STEM_CTES, f"""t AS MATERIALIZED (
  SELECT doc_id, {s.recipe_tokens('text', keep_negations=False)} AS tokens FROM documents)""", s.mapped("m", "t", "stems", "word", "stem")) + """
SELECT doc_id, array_to_string(tokens, ' ') AS stems FROM m""")
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return normalise(docs, RECIPES["sw-naive+stem"]).select("doc_id", joined_text().alias("stems"))


@add("stem_table", s.with_(STEM_CTES) + "SELECT word, stem FROM stems")
def _(spark, folder):
    """Surface word and stem of every distinct word of the texts."""
    docs = documents(spark, folder)
    words = docs.select(F.explode(tx.tokenize(tx.clean_text(F.col("text")))).alias("word")).distinct()
    return words.select("word", stem_tokens(F.array("word"))[0].alias("stem"))


LEMMA_CTES = f"""vocab AS MATERIALIZED (
  SELECT DISTINCT w AS word FROM (SELECT unnest(string_split({s.clean('text')}, ' ')) AS w FROM documents) WHERE w <> ''),
verbs AS MATERIALIZED (SELECT a.word AS surface, b.word AS lemma FROM vocab a JOIN vocab b
  ON a.word LIKE '%ed' AND length(a.word) > 4 AND b.word = substr(a.word, 1, length(a.word) - 2)),
nouns AS MATERIALIZED (SELECT a.word AS surface, b.word AS lemma FROM vocab a JOIN vocab b
  ON a.word LIKE '%s' AND length(a.word) > 3 AND b.word = substr(a.word, 1, length(a.word) - 1))"""


@add("derived_lemmas", s.with_(LEMMA_CTES) + """
    SELECT surface, 'v' AS pos, lemma FROM verbs UNION ALL SELECT surface, 'n' AS pos, lemma FROM nouns""")
def _(spark, folder):
    return derived_lemmas(spark, folder)


@add("lemmatised_tokens", s.with_(LEMMA_CTES, f"""t AS MATERIALIZED (
  SELECT doc_id, {s.recipe_tokens('text')} AS tokens FROM documents),
x AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM t),
v AS (SELECT doc_id, pos, coalesce(verbs.lemma, token) AS token FROM x LEFT JOIN verbs ON surface = token),
n AS (SELECT doc_id, pos, coalesce(nouns.lemma, token) AS token FROM v LEFT JOIN nouns ON surface = token),
g AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM n GROUP BY doc_id)""") + """
SELECT t.doc_id, coalesce(g.text, '') AS text FROM t LEFT JOIN g USING (doc_id)""")
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return normalise(docs, DEFAULT, lemmas=derived_lemmas(spark, folder)).select(
        "doc_id", joined_text().alias("text")
    )


@add("word_and_char_counts", f"""
    SELECT doc_id, CAST({s.word_count('text')} AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars FROM documents""")
def _(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id", tx.word_count(text).alias("words"), F.length(text).alias("chars")
    )


def _probe_sql(probes):
    return ", ".join(f"{s.probe(p)} AS {n}" for n, p in probes)


@add("construction_probes", f"SELECT doc_id, {_probe_sql(PROBES)} FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", *tx.probe_flags(F.col("text")))


@add("construction_probes_extended", f"SELECT doc_id, {_probe_sql(EXTENDED_PROBES)} FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", *tx.probe_flags(F.col("text"), EXTENDED_PROBES))


@add("text_slices", """
    SELECT doc_id, substr(text, 1, 400) AS first_400,
      substr(text, 1, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS first_300,
      replace(substr(text, 1, 78), chr(10), ' ') AS one_line FROM documents""")
def _(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id", F.substring(text, 1, 400).alias("first_400"),
        F.concat(F.substring(text, 1, 300), F.when(F.length(text) > 300, "...").otherwise("")).alias("first_300"),
        F.translate(F.substring(text, 1, 78), "\n", " ").alias("one_line"),
    )


# -- features ------------------------------------------------------------------ #
def _one(spark, folder):
    return model_columns(one_fit(review_tokens(spark, folder)))


FEATURES = s.with_(s.REVIEWS, s.TOKENS, s.ONE_FIT, s.tfidf("f", "one_fit"))
BINARY = s.with_(s.REVIEWS, s.TOKENS, s.ONE_FIT, s.tfidf("f", "one_fit", tf="binary", idf=False), s.class_sums("f"))


@add("term_counts", s.with_(s.REVIEWS, s.TOKENS, s.term_rows("t", "review_tokens", "doc_id")) + "SELECT * REPLACE (CAST(tf AS INTEGER) AS tf) FROM t")
def _(spark, folder):
    return feat.term_rows(review_tokens(spark, folder), ["doc_id"])


@add("vocabulary", FEATURES + "SELECT term, df, cf FROM f_vocab")
def _(spark, folder):
    terms = feat.term_rows(_one(spark, folder), ["fit", "doc_id", "label"])
    return feat.vocabulary(terms, ["fit"]).select("term", "df", "cf")


VOCAB_CAP = 2_000


@add("vocabulary_capped", s.with_(s.REVIEWS, s.TOKENS, s.ONE_FIT, s.tfidf("f", "one_fit", cap=VOCAB_CAP)) + "SELECT term, df, cf FROM f_vocab")
def _(spark, folder):
    terms = feat.term_rows(_one(spark, folder), ["fit", "doc_id", "label"])
    options = feat.VectorOptions(max_features=VOCAB_CAP)
    return feat.vocabulary(terms, ["fit"], options).select("term", "df", "cf")


@add("term_weights", s.with_(s.REVIEWS, s.TOKENS, s.term_rows("t", "review_tokens", "doc_id", 1)) + f"""
    SELECT doc_id, term, CAST(tf AS INTEGER) AS tf, {s.tf_weight('binary')} AS binary_weight,
      round({s.tf_weight('sublinear')}, 6) AS sublinear FROM t""")
def _(spark, folder):
    terms = feat.term_rows(review_tokens(spark, folder), ["doc_id"], 1)
    return terms.select(
        "doc_id", "term", "tf", feat.tf_weight(F.col("tf"), feat.NBSVM).alias("binary_weight"),
        feat.tf_weight(F.col("tf"), feat.TFIDF).alias("sublinear"),
    )


def _weighted(spark, folder, options):
    docs = _one(spark, folder)
    terms = feat.term_rows(docs, ["fit", "doc_id", "label"], options.ngram_max)
    sizes = settle(docs.groupBy("fit").agg(F.count("*").alias("n_docs")), "sizes")
    known = feat.with_idf(feat.vocabulary(terms, ["fit"], options), sizes, ["fit"], options)
    return feat.tfidf(terms, known, ["fit"], options)


@add("idf", FEATURES + "SELECT term, df, round(idf, 6) AS idf FROM f_vocab")
def _(spark, folder):
    docs = _one(spark, folder)
    vocab = feat.vocabulary(feat.term_rows(docs, ["fit", "doc_id", "label"]), ["fit"])
    sizes = settle(docs.groupBy("fit").agg(F.count("*").alias("n_docs")), "sizes")
    return feat.with_idf(vocab, sizes, ["fit"]).select("term", "df", "idf")


@add("tfidf", FEATURES + "SELECT doc_id, term, round(weight, 6) AS weight FROM f_weighted")
def _(spark, folder):
    return _weighted(spark, folder, feat.TFIDF).select("doc_id", "term", "weight")


def _ratio(weighted):
    return feat.log_count_ratio(feat.class_sums(weighted, ["fit"]), ["fit"])


RATIO = BINARY.rstrip() + """,
f_ratio AS MATERIALIZED (
  SELECT term, pos_sum + 1.0 AS p, neg_sum + 1.0 AS q,
    ln(((pos_sum + 1.0) / sum(pos_sum + 1.0) OVER ()) / ((neg_sum + 1.0) / sum(neg_sum + 1.0) OVER ())) AS r FROM f_sums)
"""


@add("log_count_ratio", RATIO + s.rounded("SELECT term, p, q, r FROM f_ratio", "p", "q", "r"))
def _(spark, folder):
    return _ratio(_weighted(spark, folder, feat.NBSVM)).select("term", "p", "q", "r")


@add("ratio_scaled_features", RATIO + s.rounded(
    "SELECT doc_id, term, weight * r AS scaled FROM f_weighted JOIN f_ratio USING (term)", "scaled"))
def _(spark, folder):
    weighted = settle(_weighted(spark, folder, feat.NBSVM), "weighted")
    return feat.scale_by_ratio(weighted, _ratio(weighted), ["fit"]).select("doc_id", "term", "scaled")


@add("discriminative_words", s.with_(s.REVIEWS, f"""w AS (
  SELECT label, unnest({s.recipe_tokens('text', True)}) AS term FROM reviews),
c AS MATERIALIZED (SELECT term, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM w GROUP BY term),
r AS MATERIALIZED (
  SELECT term, pos, neg, round(ln(((pos + 1.0) / (SELECT CAST(sum(pos) AS DOUBLE) FROM c))
    / ((neg + 1.0) / (SELECT CAST(sum(neg) AS DOUBLE) FROM c))), 9) AS log_ratio FROM c WHERE pos + neg >= 40)""") + s.rounded("""
(SELECT 'negative' AS side, * FROM r ORDER BY log_ratio, term LIMIT 18) UNION ALL
(SELECT 'positive' AS side, * FROM r ORDER BY log_ratio DESC, term LIMIT 18)""", "log_ratio", digits=9), digits=9)
def _(spark, folder):
    recipe = RECIPES["sw-keepneg"]
    return feat.discriminative_terms(normalise(reviews(spark, folder), recipe))


# -- sampling --------------------------------------------------------------------- #
H = s.md5(SEED, "doc_id")


@add("stratified_split", s.with_(s.LABELLED) + f"""
    SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {H}, doc_id)
      <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM labelled""")
def _(spark, folder):
    return sampling.stratified_split(labelled(spark, folder))


@add("threshold_split", s.with_(s.LABELLED) + f"""
    SELECT doc_id, label, CASE WHEN {s.hash_number(H)} / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS part FROM labelled""")
def _(spark, folder):
    return sampling.threshold_split(labelled(spark, folder))


@add("stratified_folds", s.with_(s.LABELLED, s.folds(5)) + "SELECT doc_id, label, fold FROM folds")
def _(spark, folder):
    return sampling.stratified_folds(labelled(spark, folder), 5)


SUBSAMPLES = f"""{curve_plan_sql("labelled")},
drawn AS MATERIALIZED (
  SELECT doc_id, label, train_size, draw FROM (
    SELECT doc_id, label, train_size, draw, count(*) OVER (PARTITION BY train_size, draw, label) AS n_label,
      count(*) OVER (PARTITION BY train_size, draw) AS total,
      row_number() OVER (PARTITION BY train_size, draw, label ORDER BY
        md5('{SEED}/' || train_size || '/' || draw || ':' || doc_id), doc_id) AS rank
    FROM labelled, plan)
  WHERE rank <= floor(train_size * CAST(n_label AS DOUBLE) / total + 0.5) OR train_size >= total)"""


@add("stratified_subsamples", s.with_(s.LABELLED, SUBSAMPLES) + "SELECT * FROM drawn")
def _(spark, folder):
    rows = labelled(spark, folder)
    total = rows.count()
    return sampling.stratified_subsamples(rows, curve_draws(total), total)


@add("sample_documents", f"SELECT doc_id, n_chars FROM documents ORDER BY {H}, doc_id LIMIT 2000")
def _(spark, folder):
    return sampling.sample_rows(table(spark, folder, "documents").select("doc_id", "n_chars"), 2_000)


@add("first_documents", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 3000")
def _(spark, folder):
    return sampling.first_rows(table(spark, folder, "documents").select("doc_id", "n_chars"), 3_000)


@add("shuffled_order", f"SELECT doc_id, row_number() OVER (ORDER BY {H}, doc_id) AS position FROM documents")
def _(spark, folder):
    return sampling.shuffled(table(spark, folder, "documents").select("doc_id"))
