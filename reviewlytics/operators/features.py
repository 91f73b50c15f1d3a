"""Weighted n-gram features as long tables, many fits at a time.

Each operator takes ``keys``: columns that name independent fits (a fold, a
draw, a recipe, a corpus). One job then serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.config import MAX_FEATURES
from reviewlytics.functions.text import counted, ngrams
from reviewlytics.operators.ranking import rank_by_range
from reviewlytics.runtime import lookup, settle


@dataclass(frozen=True)
class VectorOptions:
    """How term counts become weights."""

    ngram_max: int = 2
    min_df: int = 2
    max_features: int | None = MAX_FEATURES
    sublinear_tf: bool = True
    binary: bool = False
    use_idf: bool = True
    normalise: bool = True


TFIDF = VectorOptions()
NBSVM = VectorOptions(binary=True, sublinear_tf=False, use_idf=False)


def count_terms(docs: DataFrame, ngram_max: int = 2) -> DataFrame:
    """Add the counted n-grams as column ``terms_<n>``, for use by several fits.

    Counting happens inside the row, so nothing is shuffled.
    """
    return docs.withColumn(f"terms_{ngram_max}", counted(ngrams(F.col("tokens"), ngram_max)))


def term_rows(docs: DataFrame, keep: list[str], ngram_max: int = 2, outer: bool = False) -> DataFrame:
    """One row per document and distinct n-gram: ``keep..., term, tf``.

    Uses what :func:`count_terms` left, or counts now. ``outer`` keeps a row
    with a NULL term for documents without tokens.
    """
    ready = f"terms_{ngram_max}"
    terms = F.col(ready) if ready in docs.columns else counted(ngrams(F.col("tokens"), ngram_max))
    spread = F.inline_outer if outer else F.inline
    return docs.select(*keep, spread(terms))


def tf_weight(tf: Column, options: VectorOptions) -> Column:
    if options.binary:
        return F.when(tf > 0, F.lit(1.0))
    if options.sublinear_tf:
        return F.lit(1.0) + F.log(tf.cast("double"))
    return tf.cast("double")


def most_frequent(counts: DataFrame, keys: list[str], by: str, limit: int) -> DataFrame:
    """Exactly the ``limit`` terms with the largest ``by``, ties in term order.

    A histogram of the counts gives the count at which the list is full; only
    the ties at that count have to be ordered by name.
    """
    largest = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        return counts
    down = Window.partitionBy(*keys).orderBy(F.desc(by))
    edge = (
        counts.groupBy(*keys, by).agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(down))
        .filter(F.col("_upto") - F.col("_n") < limit)
        .groupBy(*keys)
        .agg(F.min(by).alias("_cut"), F.max_by("_n", "_upto").alias("_ties"), F.max("_upto").alias("_upto"))
        .withColumn("_room", F.lit(limit) - (F.col("_upto") - F.col("_ties")))
        .select(*keys, "_cut", "_room")
    )
    judged = lookup(counts, edge, keys)
    above = judged.filter(F.col(by) > F.col("_cut"))
    ties = rank_by_range(judged.filter(F.col(by) == F.col("_cut")), keys, [F.col("term")], "_rank")
    kept = ties.filter(F.col("_rank") <= F.col("_room"))
    return above.select(*counts.columns).unionByName(kept.select(*counts.columns))


def vocabulary(terms: DataFrame, keys: list[str], options: VectorOptions = TFIDF) -> DataFrame:
    """``keys..., term, df, cf`` of the terms kept, computed once.

    A term every document holds is combined in the map tasks, so frequent
    words do not crowd one reducer.
    """
    counts = (
        terms.groupBy(*keys, "term")
        .agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))
        .filter(F.col("df") >= options.min_df)
    )
    counts = settle(counts, "vocabulary")
    if options.max_features is None:
        return counts
    rank_by = "df" if options.binary else "cf"
    kept = most_frequent(counts, keys, rank_by, options.max_features)
    return counts if kept is counts else settle(kept, "vocabulary")


def with_idf(vocab: DataFrame, sizes: DataFrame, keys: list[str], options: VectorOptions = TFIDF) -> DataFrame:
    """Add the smoothed inverse document frequency; ``sizes`` is ``keys..., n_docs``."""
    if not options.use_idf:
        return vocab.withColumn("idf", F.lit(1.0))
    smooth = (F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))
    known = lookup(vocab, sizes, keys).withColumn("idf", F.log(smooth) + F.lit(1.0)).drop("n_docs")
    return settle(known, "idf")


def tfidf(
    terms: DataFrame, vocab_idf: DataFrame, keys: list[str], options: VectorOptions = TFIDF,
    doc_key: str = "doc_id",
) -> DataFrame:
    """Weights of known terms, scaled to unit length per document.

    One shuffle, by document. The vocabulary, at most ``max_features`` rows
    per fit, is a :func:`reviewlytics.runtime.lookup`.
    """
    known = vocab_idf.select(*keys, "term", "idf")
    raw = lookup(terms, known, [*keys, "term"]).withColumn(
        "weight", tf_weight(F.col("tf"), options) * F.col("idf")
    )
    if options.normalise:
        doc = Window.partitionBy(*keys, doc_key)
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(doc))
        raw = raw.withColumn("weight", F.col("weight") / norm)
    return raw


def class_sums(weighted: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Summed weights of each term in positive and in negative documents."""
    weight, label = F.col("weight"), F.col("label")
    return weighted.groupBy(*keys, "term").agg(
        F.sum(F.when(label == 1, weight).otherwise(F.lit(0.0))).alias("pos_sum"),
        F.sum(F.when(label == 0, weight).otherwise(F.lit(0.0))).alias("neg_sum"),
        *(extra or []),
    )


def log_count_ratio(sums: DataFrame, keys: list[str], alpha: float = 1.0) -> DataFrame:
    """``r = ln((p/|p|) / (q/|q|))`` with ``p, q`` the smoothed class sums."""
    smoothed = sums.withColumn("p", F.col("pos_sum") + F.lit(float(alpha))).withColumn(
        "q", F.col("neg_sum") + F.lit(float(alpha))
    )
    totals = smoothed.groupBy(*keys).agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    ratio = F.log((F.col("p") / F.col("_p")) / (F.col("q") / F.col("_q")))
    return settle(lookup(smoothed, totals, keys).select(*keys, "term", "p", "q", ratio.alias("r")), "ratio")


def scale_by_ratio(weighted: DataFrame, ratio: DataFrame, keys: list[str]) -> DataFrame:
    """Multiply each weight by its term's log-count ratio."""
    return lookup(weighted, ratio.select(*keys, "term", "r"), [*keys, "term"]).withColumn(
        "scaled", F.col("weight") * F.col("r")
    )


def discriminative_terms(
    docs: DataFrame, min_count: int = 40, each_end: int = 18
) -> DataFrame:
    """Tokens whose log frequency ratio between the classes is most extreme."""
    label = F.col("label")
    counts = settle(
        docs.select("label", F.explode("tokens").alias("term")).groupBy("term").agg(
            F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg")
        ),
        "class-counts",
    )
    totals = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("t")).scalar()
    rated = counts.filter(F.col("pos") + F.col("neg") >= min_count).withColumn(
        "log_ratio",
        F.log(
            ((F.col("pos") + F.lit(1.0)) / totals["pos"].cast("double"))
            / ((F.col("neg") + F.lit(1.0)) / totals["neg"].cast("double"))
        ),
    )
    rated = rated.withColumn("log_ratio", F.round("log_ratio", 9))
    ends = []
    for side, order in (("negative", F.asc), ("positive", F.desc)):
        ends.append(
            rated.orderBy(order("log_ratio"), "term").limit(each_end)
            .select(F.lit(side).alias("side"), "term", "pos", "neg", "log_ratio")
        )
    return ends[0].unionByName(ends[1])
