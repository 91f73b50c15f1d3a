"""Inputs the named queries share, read from the given tables.

documents joined with labels stand for reviews: ``source`` is the film and
``lang`` the corpus. Pages stand for raw HTML reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.config import TRAIN_SIZE_LADDER
from reviewlytics.functions.arrow import count_ngrams
from reviewlytics.operators import models, sampling
from reviewlytics.operators.features import TFIDF
from reviewlytics.operators.linear import LinearModel, with_prediction
from reviewlytics.operators.normalise import RAW, normalise
from reviewlytics.operators.reports import corpus_words
from reviewlytics.operators.solvers import BATCH_BYTES
from reviewlytics.runtime import arrow_batches, settle, settled_once, ship_package, spread, table

Query = Callable[[SparkSession, str], DataFrame]
FOLDS = 5
#: Draws per size of the ladder; all rows are drawn once.
CURVE_DRAWS = {size: 5 if size <= 2_500 else 3 for size in TRAIN_SIZE_LADDER}


def curve_draws(total: int) -> dict[int, int]:
    """The sizes below ``total`` with their draws, then ``total`` itself."""
    return {size: n for size, n in CURVE_DRAWS.items() if size < total} | {total: 1}


def turns(draws: list[tuple[int, int]], sets_at_once: int = 20, small: int = 1_000) -> list[list[int]]:
    """Places of ``draws`` (size, number of training sets) that are fitted together: small draws of a size, larger ones one by one.

    Sets share a vocabulary of terms that any of them knows, so only small ones go together in numbers.
    """
    out: list[list[int]] = []
    for i, (size, n) in enumerate(draws):
        last = out[-1] if out else []
        room = sets_at_once if size <= small else 6
        if last and draws[last[0]][0] == size and sum(draws[j][1] for j in last) + n <= room:
            last.append(i)
        else:
            out.append([i])
    return out


def curve_plan_sql(rows: str) -> str:
    """The same as a relation (train_size, draw), for the rows of a relation."""
    values = ", ".join(f"({size}, {draw})" for size, n in CURVE_DRAWS.items() for draw in range(n))
    return f"""ladder(train_size, draw) AS (VALUES {values}),
plan AS MATERIALIZED (
  SELECT train_size, draw FROM ladder WHERE train_size < (SELECT count(*) FROM {rows})
  UNION ALL SELECT CAST(count(*) AS INTEGER), 0 FROM {rows})"""

ALPHA = 0.5


class Registry:
    """Named queries, most of them with the SQL that must give the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                ship_package(spark)
                return tidy(query(spark, folder), digits)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that the order of summation does not show."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = (F.round(column, digits) + F.lit(0.0)).alias(field.name)
        out.append(column)
    return df.select(*out)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and labels only, for sampling."""
    return table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text, label, film_id, corpus, stratum_rank, stratum_size``.

    The one join that moves texts. Ranks for sampling are computed on the
    narrow label table before it and travel along.
    """
    ranked = settled_once(
        spark, folder, "ranked-labels", lambda: sampling.stratum_ranks(labelled(spark, folder))
    )
    docs = documents(spark, folder).select(
        "doc_id", "text", F.col("source").alias("film_id"), F.col("lang").alias("corpus")
    )
    return docs.join(ranked, "doc_id")


def review_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with ``tokens`` and counted terms in place of the text, computed once."""
    def build() -> DataFrame:
        # Counting reads tokens that are written: else they would be made for it, and once more for the result.
        docs = settle(normalise(reviews(spark, folder), RAW), "tokens")
        return docs.withColumn("terms_2", count_ngrams(F.col("tokens"), 2))

    with arrow_batches(spark, BATCH_BYTES):
        return settled_once(spark, folder, "review-tokens", build)


def model_columns(docs: DataFrame) -> DataFrame:
    """What a fit or a scorer reads."""
    names = ("fit", "doc_id", "label", "tokens", "terms_2")
    return docs.select(*[c for c in names if c in docs.columns])


def folded_tokens(spark: SparkSession, folder: str, k: int = FOLDS) -> DataFrame:
    return review_tokens(spark, folder).withColumn("fold", sampling.fold_number(k))


def one_fit(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fit", F.lit("all"))


def full_model(spark: SparkSession, folder: str) -> LinearModel:
    """Naive Bayes on all reviews."""
    def weights() -> DataFrame:
        vectors = models.shared_vectors("naive_bayes", review_tokens(spark, folder), kept=False)
        model = models.as_linear("naive_bayes", vectors, *vectors.naive_bayes((ALPHA,)))
        vectors.close()
        return model.weights.crossJoin(F.broadcast(model.bias.select("bias")))

    both = settled_once(spark, folder, "full-model", weights)
    bias = both.groupBy("fit").agg(F.first("bias").alias("bias"))
    return LinearModel(both.select("fit", "term", "idf", "weight"), bias, ["fit"], TFIDF)


def fold_scores(folded: DataFrame, k: int, alphas: tuple[float, ...], keep: list[str]) -> DataFrame:
    """``keep..., fold, alpha, score, pred``: every review under the Naive Bayes models of the folds it is not in."""
    placed = folded.withColumns(models.leave_out("fold", k))
    vectors = models.shared_vectors("naive_bayes", placed, k, kept=False)
    fits = vectors.naive_bayes(alphas)
    vectors.close()
    alpha = F.element_at(F.array(*[F.lit(float(f.cost)) for f in fits]), F.col("number") + 1)
    scored = vectors.scores(placed, fits, [*keep, "fold"])
    return with_prediction(scored.select(*keep, "fold", alpha.alias("alpha"), "score"))


def out_of_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Every review scored by the model of the folds it is not in.

    ``doc_id, film_id, corpus, label, score, pred``; all folds in one job.
    """
    def build() -> DataFrame:
        keep = ["doc_id", "film_id", "corpus", "label"]
        return fold_scores(folded_tokens(spark, folder), FOLDS, (ALPHA,), keep).drop("fold", "alpha")

    return settled_once(spark, folder, "out-of-fold", build)


def scored_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return out_of_fold(spark, folder).join(texts, "doc_id")


def derived_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """A lemma table read off the texts: plural and past forms of known words."""
    docs = documents(spark, folder).select(F.lit("all").alias("corpus"), "text")
    vocab = settled_once(spark, folder, "vocab-words", lambda: corpus_words(docs).select("word"))
    base = vocab.select(F.col("word").alias("lemma"))

    def forms(ending: str, pos: str) -> DataFrame:
        long = vocab.filter(F.endswith("word", F.lit(ending)) & (F.length("word") > len(ending) + 2))
        lemma = F.expr(f"substring(word, 1, length(word) - {len(ending)})").alias("lemma")
        return long.select(F.col("word").alias("surface"), F.lit(pos).alias("pos"), lemma).join(base, "lemma")

    both = forms("ed", "v").unionByName(forms("s", "n"))
    return settled_once(spark, folder, "lemmas", lambda: both.select("surface", "pos", "lemma"))


