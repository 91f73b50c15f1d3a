"""Multinomial Naive Bayes in closed form: two aggregations per fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.operators import features as feat
from reviewlytics.operators.linear import LinearModel
from reviewlytics.runtime import lookup, settle

# Log prior odds when one class has no training document: certainty.
ONE_CLASS = 500.0


def sizes_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., n_docs, n_pos, n_neg`` of the training documents."""
    return docs.groupBy(*keys).agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )


def fit(
    docs: DataFrame, keys: list[str], alphas: tuple[float, ...] = (0.5,),
    options: feat.VectorOptions = feat.TFIDF, vary_alpha: bool = False,
) -> LinearModel:
    """Fit every group of ``keys`` on ``docs`` (keys..., doc_id, label, tokens).

    With ``vary_alpha`` the smoothing value becomes a further key, so a whole
    grid costs one pass over the text.
    """
    sizes = settle(sizes_of(docs, keys), "sizes")
    terms = feat.term_rows(docs, [*keys, "doc_id", "label"], options.ngram_max)
    vocab = feat.vocabulary(terms, keys, options)
    known = feat.with_idf(vocab, sizes.select(*keys, "n_docs"), keys, options)
    weighted = feat.tfidf(terms, known, keys, options)
    sums = settle(feat.class_sums(weighted, keys, [F.first("idf").alias("idf")]), "class-sums")

    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    totals = sums.groupBy(*keys).agg(
        F.sum("pos_sum").alias("_p"), F.sum("neg_sum").alias("_q"), F.count("*").alias("_v")
    )
    alpha = F.col("alpha")

    def log_share(part: str, whole: str):
        smoothed = (F.col(part) + alpha) / (F.col(whole) + alpha * F.col("_v").cast("double"))
        return F.log(smoothed)

    weight = log_share("pos_sum", "_p") - log_share("neg_sum", "_q")
    out_keys = [*keys, "alpha"] if vary_alpha else list(keys)
    weights = lookup(sums, totals, keys).select("*", grid).select(*out_keys, "term", "idf", weight.alias("weight"))
    prior = (
        F.when(F.col("n_neg") == 0, F.lit(ONE_CLASS)).when(F.col("n_pos") == 0, F.lit(-ONE_CLASS))
        .otherwise(F.log(F.col("n_pos") / F.col("n_neg")))
    )
    bias = sizes.select(*keys, grid, prior.alias("bias")).select(*out_keys, "bias")
    return LinearModel(
        settle(weights, "weights"), settle(bias, "bias"), out_keys, options, {"model": "naive_bayes"}
    )
