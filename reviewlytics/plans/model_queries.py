"""Naive Bayes, the lexicon baseline and experiments on both."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.config import SEED
from reviewlytics.functions import text as tx
from reviewlytics.functions.arrow import count_ngrams
from reviewlytics.operators import evaluate, linear, models, naive_bayes, reports, sampling
from reviewlytics.operators.features import VectorOptions
from reviewlytics.operators.lexicon import lexicon_scores
from reviewlytics.operators.normalise import RECIPES, Recipe, normalise
from reviewlytics.operators.solvers import BATCH_BYTES, SharedVectors
from reviewlytics.plans import sql as s
from reviewlytics.plans.base import (
    ALPHA, Registry, curve_draws, curve_plan_sql, derived_lemmas, fold_scores, folded_tokens, full_model, one_fit, out_of_fold,
    review_tokens, reviews, turns,
)
from reviewlytics.plans.text_queries import LEMMA_CTES, STEM_CTES
from reviewlytics.runtime import arrow_batches, settle, settled_once, table

registry = Registry()
add = registry.add
ALPHAS = (0.1, 0.5, 1.0)
DOC = ["fit", "doc_id", "label", "tokens"]


# -- one model ------------------------------------------------------------------- #
@add("naive_bayes_weights", s.with_(s.FULL_MODEL) + s.rounded(
    "SELECT term, idf, weight, bias FROM nb_weights JOIN nb_bias USING (fit)", "idf", "weight", "bias"))
def _(spark, folder):
    model = full_model(spark, folder)
    return model.weights.join(model.bias, "fit").select("term", "idf", "weight", "bias")


@add("top_terms", s.with_(s.FULL_MODEL, "w AS MATERIALIZED (SELECT term, round(weight, 9) AS weight FROM nb_weights)") + s.rounded("""
    (SELECT 'positive' AS side, term, weight FROM w ORDER BY weight DESC, term LIMIT 20) UNION ALL
    (SELECT 'negative' AS side, term, weight FROM w ORDER BY weight, term LIMIT 20)""", "weight", digits=9), digits=9)
def _(spark, folder):
    return linear.top_terms(full_model(spark, folder))


@add("explained_reviews", s.with_(s.FULL_MODEL, f"""x AS MATERIALIZED (
  SELECT doc_id, term, {s.tf_weight('sublinear')} * idf AS x, weight
  FROM (SELECT doc_id, term, tf FROM nb_terms) JOIN nb_weights USING (term)),
c AS MATERIALIZED (SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) * weight, 9) AS contribution FROM x),
r AS (SELECT *, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS side FROM c WHERE contribution <> 0)""")
    + s.rounded("""SELECT doc_id, side, term, contribution, CAST(row_number() OVER (
      PARTITION BY doc_id, side ORDER BY abs(contribution) DESC, term) AS INTEGER) AS rank
    FROM r QUALIFY rank <= 8""", "contribution", digits=9), digits=9)
def _(spark, folder):
    docs = one_fit(review_tokens(spark, folder))
    return linear.explain(docs, full_model(spark, folder)).select("doc_id", "side", "term", "contribution", "rank")


@add("review_scores", s.with_(s.OUT_OF_FOLD) + s.rounded("""
    SELECT doc_id, label, score, pred, CASE WHEN pred = 1 THEN 'positive' ELSE 'negative' END AS sentiment,
      abs(score - 0.5) * 2.0 AS confidence FROM scored""", "score", "confidence", digits=9), digits=9)
def _(spark, folder):
    score = F.col("score")
    return out_of_fold(spark, folder).select(
        "doc_id", "label", "score", "pred", linear.sentiment(score).alias("sentiment"),
        linear.confidence(score).alias("confidence"),
    )


CONVERSATION_TURNS = f"""turns AS MATERIALIZED (
  SELECT 'all' AS fit, conv_id || ':' || turn AS doc_id, conv_id, {s.recipe_tokens('text')} AS tokens FROM conversations)"""


@add("conversation_scores", s.with_(s.FULL_MODEL, CONVERSATION_TURNS, s.scored("t", "nb", "turns", "conv_id")) + s.rounded(
    "SELECT doc_id, conv_id, score, pred FROM t", "score", digits=9), digits=9)
def _(spark, folder):
    """Another corpus scored with the saved weights: every turn of every conversation."""
    return conversation_scores(spark, folder).select("doc_id", "conv_id", "score", "pred")


def conversation_scores(spark, folder) -> DataFrame:
    turns = table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "conv_id", "text"
    )
    docs = normalise(turns, Recipe(remove_stopwords=False, normalisation="none"))
    return linear.with_prediction(linear.score(one_fit(docs), full_model(spark, folder), ["conv_id"]))


# -- rows of the scored table ------------------------------------------------------ #
@add("misclassified", s.with_(s.OUT_OF_FOLD) + s.rounded("SELECT doc_id, label, pred, score FROM scored WHERE pred <> label", "score", digits=9), digits=9)
def _(spark, folder):
    return out_of_fold(spark, folder).filter("pred <> label").select("doc_id", "label", "pred", "score")


@add("one_film", s.with_(s.OUT_OF_FOLD) + s.rounded("SELECT doc_id, label, score FROM scored WHERE film_id = 'src3'", "score", digits=9), digits=9)
def _(spark, folder):
    return out_of_fold(spark, folder).filter("film_id = 'src3'").select("doc_id", "label", "score")


@add("film_prefix", s.with_(s.OUT_OF_FOLD) + """
    SELECT film_id, count(*) AS n FROM scored WHERE film_id LIKE 'src1%' GROUP BY film_id""")
def _(spark, folder):
    return out_of_fold(spark, folder).filter(F.startswith("film_id", F.lit("src1"))).groupBy("film_id").agg(
        F.count("*").alias("n")
    )


@add("reindexed_accuracy", s.with_(s.OUT_OF_FOLD, "target(position, corpus) AS (VALUES (1, 'de'), (2, 'en'), (3, 'it'), (4, 'fr'))") + s.rounded("""
    SELECT position, corpus, accuracy FROM target LEFT JOIN (
      SELECT corpus, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM scored GROUP BY corpus) USING (corpus)""", "accuracy"))
def _(spark, folder):
    """Results put in a given order of keys, missing keys kept."""
    order = spark.createDataFrame([(1, "de"), (2, "en"), (3, "it"), (4, "fr")], "position int, corpus string")
    found = reports.by_slice(out_of_fold(spark, folder), "corpus").select("corpus", "accuracy")
    return order.join(found, "corpus", "left").select("position", "corpus", "accuracy")


# -- lexicon ------------------------------------------------------------------------ #
LEXICON = f"""marked AS MATERIALIZED (SELECT doc_id, label, {s.negated('tokens')} AS tokens FROM review_tokens),
word_counts AS MATERIALIZED (
  SELECT word, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM (SELECT label, unnest(tokens) AS word FROM review_tokens) GROUP BY word),
lexicon AS MATERIALIZED (
  SELECT word, round(ln((pos + 1.0) / (neg + 1.0)) - ln((SELECT sum(pos) FROM word_counts) / (SELECT sum(neg) FROM word_counts)), 3) AS valence
  FROM word_counts),
hits AS (
  SELECT m.doc_id, sum(CASE WHEN m.token LIKE '%\\_NEG' ESCAPE '\\' THEN -valence ELSE valence END) AS x
  FROM (SELECT doc_id, unnest(tokens) AS token FROM marked) m JOIN lexicon ON word = {s.bare('m.token')} GROUP BY m.doc_id),
lexicon_scored AS MATERIALIZED (
  SELECT doc_id, label, round(coalesce(x, 0.0) / sqrt(coalesce(x, 0.0) ** 2 + 15.0), 9) AS compound
  FROM review_tokens LEFT JOIN hits USING (doc_id))"""


def derived_lexicon(spark, folder) -> DataFrame:
    """A word list with valences, read off the reviews themselves."""
    words = review_tokens(spark, folder).select("label", F.explode("tokens").alias("word"))
    counts = settled_once(spark, folder, "word-counts", lambda: words.groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    ))
    odds = counts.agg(F.log(F.sum("pos") / F.sum("neg")).alias("o")).scalar()
    valence = F.log((F.col("pos") + F.lit(1.0)) / (F.col("neg") + F.lit(1.0))) - odds
    return settle(counts.select(
        "word", F.round(valence, 3).alias("valence")
    ), "lexicon")


@add("lexicon_baseline", s.with_(s.REVIEWS, s.TOKENS, LEXICON) + s.rounded("""
    SELECT doc_id, label, compound, (compound + 1.0) / 2.0 AS score, CAST(compound >= 0 AS INTEGER) AS pred
    FROM lexicon_scored""", "compound", "score", digits=10), digits=10)
def _(spark, folder):
    return _lexicon_scored(spark, folder)


def _lexicon_scored(spark, folder) -> DataFrame:
    docs = review_tokens(spark, folder).withColumn("tokens", tx.mark_negation(F.col("tokens")))
    return lexicon_scores(docs, derived_lexicon(spark, folder), ["label"])


# -- experiments: many fits in one job ----------------------------------------------- #
K = 5
CV = f"""{s.folds(K)},
folded AS MATERIALIZED (SELECT t.doc_id, t.label, t.tokens, fold, fold AS fit FROM review_tokens t JOIN folds USING (doc_id)),
fold_train AS MATERIALIZED (
  SELECT f.fit, t.doc_id, t.label, t.tokens FROM folded t, (SELECT CAST(unnest(range({K})) AS INTEGER) AS fit) f WHERE t.fold <> f.fit),
nb_alphas AS (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in ALPHAS)}]) AS alpha)"""
CV_SCORED = s.with_(s.REVIEWS, s.LABELLED, s.TOKENS, CV, s.naive_bayes("nb", "fold_train", alpha="alpha"),
                    s.scored("cv", "nb", "folded", "label", model_keys="fit, alpha"))


def cross_validated(spark, folder) -> DataFrame:
    """Every review scored out of fold for every smoothing value."""
    def build():
        scored = fold_scores(folded_tokens(spark, folder, K), K, ALPHAS, ["doc_id", "label"])
        return scored.withColumnRenamed("fold", "fit")

    return settled_once(spark, folder, "cross-validated", build)


@add("tuned_smoothing", CV_SCORED + s.rounded("""
    SELECT alpha, avg(accuracy) AS cv_accuracy, min(accuracy) AS worst_fold, max(accuracy) AS best_fold FROM (
      SELECT alpha, fit, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM cv GROUP BY alpha, fit) GROUP BY alpha""",
    "cv_accuracy", "worst_fold", "best_fold"))
def _(spark, folder):
    per_fold = cross_validated(spark, folder).groupBy("alpha", "fit").agg(F.avg(reports.right()).alias("accuracy"))
    return per_fold.groupBy("alpha").agg(
        F.avg("accuracy").alias("cv_accuracy"), F.min("accuracy").alias("worst_fold"), F.max("accuracy").alias("best_fold")
    )


PREDICTIONS = f"""predictions AS MATERIALIZED (
  SELECT 'alpha=' || alpha AS model, doc_id, label, pred FROM cv
  UNION ALL SELECT 'lexicon', doc_id, label, CAST(compound >= 0 AS INTEGER) FROM lexicon_scored),
best AS (
  SELECT model AS best FROM predictions GROUP BY model ORDER BY avg(CAST(pred = label AS INTEGER)) DESC, model DESC LIMIT 1),
pairs AS (
  SELECT p.model, any_value(best) AS best, count(*) FILTER (b.pred = b.label AND p.pred <> p.label) AS n01,
    count(*) FILTER (b.pred <> b.label AND p.pred = p.label) AS n10
  FROM predictions p JOIN predictions b USING (doc_id), best WHERE b.model = best AND p.model <> best GROUP BY p.model)"""


def predictions(spark, folder) -> DataFrame:
    grid = cross_validated(spark, folder).select(
        F.concat(F.lit("alpha="), F.col("alpha").cast("string")).alias("model"), "doc_id", "label", "pred"
    )
    words = _lexicon_scored(spark, folder).select(F.lit("lexicon").alias("model"), "doc_id", "label", "pred")
    return grid.unionByName(words)


@add("mcnemar_against_best", CV_SCORED.rstrip() + ",\n" + LEXICON + ",\n" + PREDICTIONS + s.rounded(f"""
    SELECT best || ' vs ' || model AS comparison, n01, n10, p_value, p_value < 0.05 AS significant_at_05
    FROM (SELECT *, {s.mcnemar_p('n01', 'n10')} AS p_value FROM pairs)""", "p_value"))
def _(spark, folder):
    return evaluate.mcnemar(predictions(spark, folder))


@add("model_comparison", CV_SCORED.rstrip() + ",\n" + LEXICON + ",\n" + PREDICTIONS + s.rounded("""
    SELECT model, count(*) AS n, avg(CAST(pred = label AS DOUBLE)) AS accuracy, rank() OVER (
      ORDER BY round(avg(CAST(pred = label AS DOUBLE)), 9) DESC, model) = 1 AS deployed FROM predictions GROUP BY model""", "accuracy"))
def _(spark, folder):
    """Accuracy per model; the most accurate one is marked for use."""
    rated = settle(predictions(spark, folder).groupBy("model").agg(
        F.count("*").alias("n"), F.avg(reports.right()).alias("accuracy")
    ))
    first = rated.agg(F.min_by("model", F.struct(-F.round("accuracy", 9), "model")).alias("m")).scalar()
    return rated.withColumn("deployed", F.col("model") == first)


SPLIT = f"""split AS MATERIALIZED (
  SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {s.md5(SEED, 'doc_id')}, doc_id)
    <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM labelled)"""
# Recipes whose every step is expressible in SQL.
SQL_RECIPES = {
    "raw": Recipe(remove_stopwords=False, normalisation="none"),
    "sw-naive": RECIPES["sw-naive"],
    "sw-keepneg": RECIPES["sw-keepneg"],
    "sw-keepneg+negmark": Recipe(normalisation="none", negation_marking=True),
}
_MARKS = f"""cleaned AS MATERIALIZED (SELECT doc_id, label, {s.tokenize(s.clean('text'))} AS tk FROM reviews),
with_marks AS MATERIALIZED (SELECT doc_id, label, {s.long_enough('tk')} AS tk, {s.negated('tk')} AS mk FROM cleaned),
marks AS MATERIALIZED (SELECT doc_id, label, tk, {s.long_enough('mk')} AS mk FROM with_marks),
naive AS MATERIALIZED (SELECT doc_id, label, {s.without_stops('tk', False)} AS tokens FROM marks),
aware AS MATERIALIZED (SELECT doc_id, label, {s.without_stops('tk', True)} AS tokens FROM marks),
marked AS MATERIALIZED (SELECT doc_id, label, {s.without_stops('mk', True)} AS tokens FROM marks),
whole AS MATERIALIZED (SELECT doc_id, label, tk AS tokens FROM marks)"""


def _recipes_sql(relations: dict[str, str]) -> str:
    """CTEs ``recipes``, ``r_train`` and ``r_test`` from a relation (doc_id, label, tokens) per recipe."""
    made = " UNION ALL ".join(f"SELECT '{name}' AS fit, doc_id, label, tokens FROM {relation}" for name, relation in relations.items())
    parts = ",\n".join(
        f"r_{part} AS MATERIALIZED (SELECT fit, doc_id, label, tokens FROM recipes JOIN (SELECT doc_id FROM split WHERE part = '{part}') USING (doc_id))"
        for part in ("train", "test")
    )
    return f"recipes AS MATERIALIZED ({made}),\n{parts}"


_STEPS = _MARKS + ",\n" + _recipes_sql({"raw": "whole", "sw-naive": "naive", "sw-keepneg": "aware", "sw-keepneg+negmark": "marked"})
_KEYS = "doc_id, label"
_ALL_STEPS = ",\n".join([
    _MARKS, STEM_CTES, LEMMA_CTES,
    """lemma_map AS MATERIALIZED (
  SELECT word, coalesce(n.lemma, v.lemma, word) AS lemma FROM vocab LEFT JOIN verbs v ON v.surface = word
    LEFT JOIN nouns n ON n.surface = coalesce(v.lemma, word))""",
    s.mapped("aware_stems", "aware", "stems", "word", "stem", _KEYS), s.mapped("naive_stems", "naive", "stems", "word", "stem", _KEYS),
    s.mapped("aware_lemmas", "aware", "lemma_map", "word", "lemma", _KEYS), s.mapped("whole_lemmas", "whole", "lemma_map", "word", "lemma", _KEYS),
    s.mapped("marked_lemmas", "marked", "lemma_map", "word", "lemma", _KEYS),
    _recipes_sql({
        "raw": "whole", "sw-naive": "naive", "sw-keepneg": "aware", "sw-keepneg+stem": "aware_stems", "sw-keepneg+lemma": "aware_lemmas",
        "sw-naive+stem": "naive_stems", "lemma-only": "whole_lemmas", "sw-keepneg+lemma+negmark": "marked_lemmas",
    }),
])


def recipe_tokens(spark, folder, recipes: dict[str, Recipe], lemmas: DataFrame | None = None) -> DataFrame:
    """Reviews under every recipe as ``fit``, with their part of the split."""
    base = reviews(spark, folder).select("doc_id", "label", "text", sampling.split_part().alias("part"))
    made = None
    for name, recipe in recipes.items():
        one = normalise(base, recipe, lemmas=lemmas).select(
            F.lit(name).alias("fit"), "doc_id", "label", "part", "tokens"
        )
        made = one if made is None else made.unionByName(one)
    return settle(made, "recipes")


def _by_joins(docs: DataFrame, options: VectorOptions) -> tuple[DataFrame, DataFrame]:
    model = naive_bayes.fit(docs.filter("part = 'train'").select(DOC), ["fit"], (ALPHA,), options)
    scored = linear.score(docs.filter("part = 'test'").select(DOC), model, ["label"])
    sizes = model.weights.groupBy("fit").agg(F.count("*").alias("n_features"))
    return linear.with_prediction(scored), sizes


def recipe_runs(docs: DataFrame, n_max: int) -> tuple[DataFrame, DataFrame]:
    """Hold-out predictions and vocabulary sizes of every recipe, one job.

    Recipes are training sets of the same solver pass; terms are joined and
    sorted by document only where rows share a key, and thus a length.
    """
    options, ready = VectorOptions(ngram_max=n_max), f"terms_{n_max}"
    recipes = docs.groupBy("fit", "doc_id").count().groupBy("fit").agg(F.max("count").alias("most")).orderBy("fit").collect()
    if any(r["most"] > 1 for r in recipes):
        return _by_joins(docs, options)
    names = [r["fit"] for r in recipes]
    number = F.array(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("fit")).cast("int") - 1)
    none = F.array().cast("array<int>")
    placed = docs.withColumns({
        "trains": F.when(F.col("part") == "train", number).otherwise(none), "held": F.when(F.col("part") == "test", number).otherwise(none),
    })
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        placed = settle(placed.withColumn(ready, count_ngrams(F.col("tokens"), n_max)).drop("tokens"), "recipe-terms")
    vectors = SharedVectors(placed, options, max(1, len(names)), kept=False)
    fits = vectors.naive_bayes((ALPHA,))
    vectors.close()
    scored = vectors.scores(placed.filter("part = 'test'"), fits, ["fit", "doc_id", "label"]).drop("number")
    sizes = [(name, f.n_features) for name, f in zip(names, fits, strict=False) if f.n_features]
    return linear.with_prediction(scored), docs.sparkSession.createDataFrame(sizes, "fit string, n_features long")


def ablation(docs: DataFrame) -> DataFrame:
    kept = docs.filter("part = 'train'").groupBy("fit").agg(
        F.sum(F.size("tokens")).cast("bigint").alias("tokens_kept")
    )
    out = None
    for n_max, name in ((1, "unigrams"), (2, "unigrams + bigrams")):
        scored, sizes = recipe_runs(docs, n_max)
        rows = scored.groupBy("fit").agg(F.avg(reports.right()).alias("val_accuracy")).join(sizes, "fit").join(kept, "fit")
        rows = rows.select(F.col("fit").alias("config"), F.lit(name).alias("features"),
                           "val_accuracy", "n_features", "tokens_kept")
        out = rows if out is None else out.unionByName(rows)
    return out


def _ablation_sql(n_max: int, name: str) -> str:
    return f"""SELECT a.fit AS config, '{name}' AS features, val_accuracy, n_features, tokens_kept FROM
      (SELECT fit, avg(CAST(pred = label AS DOUBLE)) AS val_accuracy FROM s{n_max} GROUP BY fit) a
      JOIN (SELECT fit, count(*) AS n_features FROM n{n_max}_weights GROUP BY fit) b USING (fit)
      JOIN (SELECT fit, CAST(sum(len(tokens)) AS BIGINT) AS tokens_kept FROM r_train GROUP BY fit) c USING (fit)"""


def _runs_sql(steps: str) -> str:
    return s.with_(
        s.REVIEWS, s.LABELLED, SPLIT, steps,
        s.naive_bayes("n1", "r_train", n_max=1), s.scored("s1", "n1", "r_test", "label", n_max=1),
        s.naive_bayes("n2", "r_train"), s.scored("s2", "n2", "r_test", "label"),
    )


RECIPE_RUNS = _runs_sql(_STEPS)
_ABLATION = s.rounded(_ablation_sql(1, "unigrams") + " UNION ALL " + _ablation_sql(2, "unigrams + bigrams"), "val_accuracy")


@add("recipe_ablation", RECIPE_RUNS + _ABLATION)
def _(spark, folder):
    return ablation(recipe_tokens(spark, folder, SQL_RECIPES))


@add("recipe_ablation_all", _runs_sql(_ALL_STEPS) + _ABLATION)
def _(spark, folder):
    """All eight recipes, with stems and lemmas."""
    lemmas = derived_lemmas(spark, folder)
    return ablation(recipe_tokens(spark, folder, RECIPES, lemmas))


@add("recipe_ranking", RECIPE_RUNS + f"""
SELECT *, CAST(row_number() OVER (ORDER BY val_accuracy DESC, config, features) AS INTEGER) AS place FROM ({_ABLATION})""")
def _(spark, folder):
    """The ablation's table, best accuracy first."""
    found = ablation(recipe_tokens(spark, folder, SQL_RECIPES))
    return reports.sorted_by(found.withColumn("val_accuracy", F.round("val_accuracy", 6)), "val_accuracy", ["config", "features"])


@add("recipe_comparison", RECIPE_RUNS.rstrip() + """,
pair AS (SELECT avg(CAST(a.pred = a.label AS DOUBLE)) AS raw_accuracy, avg(CAST(b.pred = b.label AS DOUBLE)) AS naive_accuracy,
    count(*) FILTER (a.pred = a.label AND b.pred <> b.label) AS n01, count(*) FILTER (a.pred <> a.label AND b.pred = b.label) AS n10
  FROM s2 a JOIN s2 b USING (doc_id) WHERE a.fit = 'raw' AND b.fit = 'sw-naive')""" + s.rounded(
    f"SELECT raw_accuracy, naive_accuracy, n01, n10, {s.mcnemar_p('n01', 'n10')} AS p_value FROM pair",
    "raw_accuracy", "naive_accuracy", "p_value"))
def _(spark, folder):
    """Two recipes on the same hold-out reviews, with the paired test."""
    two = {name: SQL_RECIPES[name] for name in ("raw", "sw-naive")}
    scored, _sizes = recipe_runs(recipe_tokens(spark, folder, two), 2)
    right = reports.right()
    a = scored.filter("fit = 'raw'").select("doc_id", right.alias("a"))
    b = scored.filter("fit = 'sw-naive'").select("doc_id", right.alias("b"))
    counts = a.join(b, "doc_id").agg(
        F.avg("a").alias("raw_accuracy"), F.avg("b").alias("naive_accuracy"),
        F.count_if(F.col("a") > F.col("b")).alias("n01"), F.count_if(F.col("a") < F.col("b")).alias("n10"),
    )
    return counts.withColumn("p_value", evaluate.mcnemar_p_value(F.col("n01"), F.col("n10")))


CURVE = f"""pool AS MATERIALIZED (SELECT doc_id, label FROM split WHERE part = 'train'),
{curve_plan_sql("pool")},
drawn AS MATERIALIZED (
  SELECT doc_id, label, train_size, draw, train_size || '/' || draw AS fit FROM (
    SELECT doc_id, label, train_size, draw, count(*) OVER (PARTITION BY train_size, draw, label) AS n_label,
      count(*) OVER (PARTITION BY train_size, draw) AS total,
      row_number() OVER (PARTITION BY train_size, draw, label ORDER BY
        md5('{SEED}/' || train_size || '/' || draw || ':' || doc_id), doc_id) AS rank
    FROM pool, plan)
  WHERE rank <= floor(train_size * CAST(n_label AS DOUBLE) / total + 0.5) OR train_size >= total),
c_train AS MATERIALIZED (SELECT d.fit, t.doc_id, t.label, t.tokens FROM drawn d JOIN review_tokens t USING (doc_id)),
c_test AS MATERIALIZED (
  SELECT f.fit, t.doc_id, t.label, t.tokens FROM review_tokens t JOIN split p USING (doc_id), (SELECT DISTINCT fit FROM drawn) f
  WHERE p.part = 'test'),
cb_alphas AS (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in ALPHAS)}]) AS alpha),
{s.naive_bayes('cb', 'c_train', alpha='alpha')},
{s.scored('cs', 'cb', 'c_test', 'label', model_keys='fit, alpha')},
runs AS MATERIALIZED (
  SELECT 'alpha=' || alpha AS model, CAST(split_part(fit, '/', 1) AS INTEGER) AS train_size, accuracy, n_features, alpha AS parameter
  FROM (SELECT fit, alpha, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM cs GROUP BY fit, alpha)
  JOIN (SELECT fit, CAST(count(*) AS DOUBLE) AS n_features FROM cb_vocab GROUP BY fit) USING (fit)),
curve AS MATERIALIZED (
  SELECT model, train_size, count(*) AS repeats, avg(accuracy) AS accuracy_mean, min(accuracy) AS accuracy_min,
    max(accuracy) AS accuracy_max, stddev_pop(accuracy) AS accuracy_std, avg(n_features) AS n_features_mean,
    median(parameter) AS median_parameter FROM runs GROUP BY model, train_size)"""
CURVE_CTES = s.with_(s.REVIEWS, s.LABELLED, s.TOKENS, SPLIT, CURVE)


def learning_curve(spark, folder) -> DataFrame:
    """All sizes, draws and smoothing values fitted and scored in one job."""
    def build():
        tokens = review_tokens(spark, folder).select(
            "doc_id", "label", "terms_2", sampling.split_part().alias("part")
        )
        pool = tokens.filter("part = 'train'").select("doc_id", "label")
        total = pool.count()
        drawn = sampling.stratified_subsamples(pool, curve_draws(total), total)
        drawn = settle(drawn.select("doc_id", F.concat_ws("/", "train_size", "draw").alias("fit")), "drawn")
        names = [f"{size}/{draw}" for size, n in curve_draws(total).items() for draw in range(n)]
        number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("fit")) - 1
        sets = drawn.groupBy("doc_id").agg(F.collect_list(number.cast("int")).alias("trains"))
        held = F.when(F.col("part") == "test", F.array(*[F.lit(i) for i in range(len(names))])).otherwise(F.array().cast("array<int>"))
        placed = settle(tokens.join(sets, "doc_id", "left").withColumn("held", held), "curve-tokens")
        runs = []
        for some in turns([(int(x.split("/")[0]), 1) for x in names]):
            vectors = models.shared_vectors("naive_bayes", models.some_sets(placed, some[0], len(some)), len(some))
            fits = vectors.naive_bayes(ALPHAS)
            runs += [
                {"model": f"alpha={f.cost}", "train_size": int(names[some[f.train]].split("/")[0]), "accuracy": float(a), "n_features": float(f.n_features), "parameter": f.cost}
                for f, a in zip(fits, vectors.accuracies(fits), strict=True)
            ]
            vectors.close()
        runs = pd.DataFrame(runs)
        return reports.learning_curve(spark.createDataFrame(runs, "model string, train_size int, accuracy double, n_features double, parameter double"))

    return settled_once(spark, folder, "learning-curve", build)


@add("learning_curve", CURVE_CTES + s.rounded("SELECT * FROM curve", "accuracy_mean", "accuracy_min", "accuracy_max",
                                              "accuracy_std", "n_features_mean"))
def _(spark, folder):
    return learning_curve(spark, folder)


@add("learning_curve_pivot", CURVE_CTES + s.rounded("""
    SELECT train_size, max(accuracy_mean) FILTER (model = 'alpha=0.1') AS alpha_small,
      max(accuracy_mean) FILTER (model = 'alpha=0.5') AS alpha_medium, max(accuracy_mean) FILTER (model = 'alpha=1.0') AS alpha_large
    FROM curve GROUP BY train_size""", "alpha_small", "alpha_medium", "alpha_large"))
def _(spark, folder):
    wide = reports.curve_pivot(learning_curve(spark, folder), [f"alpha={a}" for a in ALPHAS])
    return wide.toDF("train_size", "alpha_small", "alpha_medium", "alpha_large")


@add("label_efficiency", CURVE_CTES.rstrip() + """,
best AS (SELECT model, train_size, round(accuracy_mean, 9) AS a FROM curve ORDER BY train_size DESC, a DESC, model LIMIT 1)""" + s.rounded("""
    SELECT c.model, c.train_size, accuracy_mean AS accuracy, 100.0 * accuracy_mean / a AS share_of_full_pct,
      100.0 * CAST(c.train_size AS DOUBLE) / best.train_size AS label_cost_pct
    FROM curve c JOIN best USING (model)""", "accuracy", "share_of_full_pct", "label_cost_pct"))
def _(spark, folder):
    return reports.label_efficiency(learning_curve(spark, folder))


TRANSFER_FOLDS = 5
TRANSFER = f"""{s.folds(TRANSFER_FOLDS)},
home AS MATERIALIZED (SELECT t.doc_id, t.label, t.corpus, t.tokens, fold FROM review_tokens t JOIN folds USING (doc_id)),
t_train AS MATERIALIZED (
  SELECT corpus AS fit, doc_id, label, tokens FROM home
  UNION ALL SELECT corpus || '/' || f, doc_id, label, tokens FROM home, (SELECT CAST(unnest(range({TRANSFER_FOLDS})) AS INTEGER) AS f) WHERE fold <> f),
t_test AS MATERIALIZED (
  SELECT c.corpus AS fit, doc_id, label, h.corpus AS evaluated_on, tokens FROM home h, (SELECT DISTINCT corpus FROM home) c WHERE c.corpus <> h.corpus
  UNION ALL SELECT corpus || '/' || fold, doc_id, label, corpus, tokens FROM home),
{s.naive_bayes('tb', 't_train')},
{s.scored('ts', 'tb', 't_test', 'label, evaluated_on')},
reference AS (SELECT evaluated_on, avg(CAST(pred = label AS DOUBLE)) AS reference_accuracy FROM ts WHERE fit LIKE '%/%' GROUP BY evaluated_on)"""


@add("transfer", s.with_(s.REVIEWS, s.LABELLED, s.TOKENS, TRANSFER) + s.rounded("""
    SELECT fit AS trained_on, evaluated_on, n, accuracy, reference_accuracy, (reference_accuracy - accuracy) * 100.0 AS gap_pp
    FROM (SELECT fit, evaluated_on, count(*) AS n, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM ts
      WHERE fit NOT LIKE '%/%' GROUP BY fit, evaluated_on) JOIN reference USING (evaluated_on)""",
    "accuracy", "reference_accuracy", "gap_pp"))
def _(spark, folder):
    """Each corpus' model on every other corpus, against cross-validation at home."""
    k = TRANSFER_FOLDS
    home = folded_tokens(spark, folder, k)
    corpora = [r[0] for r in home.select("corpus").distinct().orderBy("corpus").collect()]
    # Home c has k + 1 sets from c * (k + 1): the corpus, judged abroad, and the corpus without each of its folds.
    n, every = len(corpora), F.array(*[F.lit(c) for c in corpora])
    own = (F.array_position(every, F.col("corpus")) - 1).cast("int")
    inner = F.transform(models.leave_out("fold", k)["trains"], lambda i: own * (k + 1) + 1 + i)
    abroad = F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: c != own), lambda c: c * (k + 1))
    placed = settle(home.select(
        "label", "terms_2", own.alias("slice"), F.concat(F.array(own * (k + 1)), inner).alias("trains"),
        F.concat(abroad, F.array(own * (k + 1) + 1 + F.col("fold"))).alias("held"),
    ), "transfer-tokens")
    rows, own_folds = [], []
    # Homes take turns: what is held and summed goes by the sets and the vocabulary of one.
    for h, name in enumerate(corpora):
        vectors = models.shared_vectors("naive_bayes", models.some_sets(placed, h * (k + 1), k + 1), k + 1, n)
        right, docs = vectors.hits(vectors.naive_bayes((ALPHA,)))
        vectors.close()
        rows += [(name, corpora[c], int(docs[c, 0]), float(right[c, 0] / docs[c, 0])) for c in range(n) if docs[c, 0]]
        own_folds.append((name, float(right[h, 1:].sum() / docs[h, 1:].sum())))
    metrics = spark.createDataFrame(rows, "trained_on string, evaluated_on string, n long, accuracy double")
    reference = spark.createDataFrame(own_folds, "evaluated_on string, reference_accuracy double")
    return reports.transfer_table(metrics, reference)


