"""Corpus statistics, slices of a scored table and experiment summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.config import LABEL_NAMES, PROBES
from reviewlytics.functions.text import clean_text, let, probe_flags, word_count
from reviewlytics.operators.features import most_frequent
from reviewlytics.operators.linear import confidence
from reviewlytics.runtime import lookup, settle

LENGTH_EDGES = tuple(float(e) for e in np.logspace(0.5, 3.6, 46))


def right() -> Column:
    return (F.col("pred") == F.col("label")).cast("double")


# -- corpora ------------------------------------------------------------- #
def corpus_words(docs: DataFrame, corpus: str = "corpus", text: str = "text") -> DataFrame:
    """``corpus, word, n``: cleaned words of every document, counted.

    Repeated words are counted inside the row and combined in the map tasks.
    """
    pieces = F.split(clean_text(F.col(text)), " ")
    return (
        docs.select(corpus, F.explode(pieces).alias("word")).filter("word <> ''")
        .groupBy(corpus, "word").agg(F.count("*").alias("n"))
    )


def corpus_statistics(docs: DataFrame, corpus: str = "corpus", text: str = "text", label: str | None = "label",
                      exact: bool = True) -> DataFrame:
    """Sizes, balance and length quantiles per corpus.

    Exact percentiles of whole-number lengths keep one counter per distinct
    length; ``exact=False`` uses sketches instead.
    """
    sized = docs.select(
        corpus, word_count(F.col(text)).alias("words"), F.length(text).alias("chars"),
        *([F.col(label).cast("double").alias("_label")] if label else []),
    )

    def at(column: str, q: float) -> Column:
        if exact:
            return F.percentile(column, F.lit(q))
        return F.percentile_approx(column, q, 10_000).cast("double")

    aggs = [F.count("*").alias("documents")]
    if label:
        aggs.append((F.avg("_label") * F.lit(100.0)).alias("positive_pct"))
    aggs += [
        at("words", 0.5).alias("median_words"), F.avg("words").alias("mean_words"),
        at("words", 0.9).alias("p90_words"), F.max("words").alias("max_words"),
        at("chars", 0.5).alias("median_chars"),
    ]
    return sized.groupBy(corpus).agg(*aggs)


def vocabulary_size(words: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Distinct words per corpus and the percentage that occur once."""
    return words.groupBy(corpus).agg(
        F.count("*").alias("vocab"),
        (F.avg((F.col("n") == 1).cast("double")) * F.lit(100.0)).alias("hapax_pct"),
    )


def vocabulary_overlap(
    words: DataFrame, pairs: list[tuple[str, str]], top: int = 5_000, corpus: str = "corpus"
) -> DataFrame:
    """Jaccard index of the ``top`` most frequent words of each pair of corpora."""
    counts = settle(words.select(corpus, F.col("word").alias("term"), "n"), "corpus-words")
    kept = most_frequent(counts, [corpus], "n", top).select(corpus, "term")
    sides = F.inline(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs
    ]))
    tagged = kept.select("*", sides).filter((F.col(corpus) == F.col("left")) | (F.col(corpus) == F.col("right")))
    per_word = tagged.groupBy("left", "right", "term").agg(F.count("*").alias("sides"))
    return per_word.groupBy("left", "right").agg(
        F.avg((F.col("sides") == 2).cast("double")).alias("jaccard")
    )


def truncation_exposure(docs: DataFrame, corpus: str = "corpus", text: str = "text", limits=(256, 512)) -> DataFrame:
    sized = docs.select(corpus, word_count(F.col(text)).alias("words"))
    return sized.groupBy(corpus).agg(*[
        (F.avg((F.col("words") > n).cast("double")) * F.lit(100.0)).alias(f"share_over_{n}_pct") for n in limits
    ])


def length_histogram(docs: DataFrame, corpus: str = "corpus", text: str = "text") -> DataFrame:
    """Share of each corpus per logarithmic length bin; the last bin is closed.

    Documents outside the edges are in no bin but stay in the denominator.
    """
    sized = docs.select(corpus, word_count(F.col(text)).cast("double").alias("words"))
    edges = F.array(*[F.lit(e) for e in LENGTH_EDGES])
    index = let(F.col("words"), lambda w: F.size(F.filter(edges, lambda e: e <= w))) - 1
    last = len(LENGTH_EDGES) - 2
    index = F.when(F.col("words") == F.lit(LENGTH_EDGES[-1]), last).otherwise(index)
    counts = sized.groupBy(corpus, index.alias("bin")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(corpus))
    return (
        counts.withColumn("share", F.col("n").cast("double") / whole.cast("double"))
        .filter((F.col("bin") >= 0) & (F.col("bin") <= last))
    )


def sorted_by(table: DataFrame, metric: str, ties: list[str], descending: bool = True) -> DataFrame:
    """A result table in the order of one metric, with each row's ``place`` from 1.

    For tables with a row per model, recipe or slice: they are small, and one
    task numbers them. Missing values come last, equal ones in the order of
    ``ties``.
    """
    order = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    return table.withColumn("place", F.row_number().over(Window.orderBy(order, *ties))).orderBy("place")


def balance(docs: DataFrame, corpus: str = "corpus") -> DataFrame:
    return docs.groupBy(corpus).agg(
        F.count("*").alias("n"), (F.avg(F.col("label").cast("double")) * F.lit(100.0)).alias("positive_pct")
    )


def token_budget(docs: DataFrame, limit: int = 256, tokens: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """How much of the documents a model that reads ``limit`` tokens would see."""
    n = F.size(tokens)
    sized = docs.select(*(by or []), n.alias("n"))
    return sized.groupBy(*(by or [])).agg(
        F.count("*").alias("n_documents"), F.percentile("n", F.lit(0.5)).alias("median_tokens"),
        F.avg("n").alias("mean_tokens"), F.percentile("n", F.lit(0.9)).alias("p90_tokens"),
        F.max("n").alias("max_tokens"),
        (F.avg((F.col("n") > limit).cast("double")) * F.lit(100.0)).alias("share_truncated_pct"),
        (F.lit(100.0) * F.sum(F.least(F.col("n"), F.lit(limit))).cast("double") / F.sum("n").cast("double"))
        .alias("retained_pct"),
    )


def integrity(reviews: DataFrame, film: str = "film_id", per_film: list[str] | None = None, cap: int = 30,
              min_films: int = 3_000, id_pattern: str = r"^tt\d+$", rating: str | None = "rating") -> DataFrame:
    """``rule, violations`` for the invariants a review corpus should satisfy."""
    label = F.col("label")
    checks = {
        "label is 0 or 1": ~F.coalesce(label.isin(0, 1), F.lit(False)),
        "text is not empty": F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0,
        "film is known": F.col(film).isNull(),
        "film id has the right form": ~F.rlike(film, F.lit(id_pattern)),
    }
    if rating:
        stars = F.col(rating)
        checks["rating agrees with label"] = ~F.coalesce(
            ((label == 0) & (stars <= 4)) | ((label == 1) & (stars >= 7)), F.lit(False)
        )
    one = reviews.agg(*[F.count_if(bad).alias(f"_{i}") for i, bad in enumerate(checks.values())])
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations"))
        for i, rule in enumerate(checks)
    ])))
    group = per_film or [film, "label"]
    sizes = reviews.groupBy(*group).agg(F.count("*").alias("n"))
    crowded = sizes.agg(F.count_if(F.col("n") > cap).alias("violations"))
    films = reviews.agg(F.count_distinct(film).alias("n")).select(
        F.greatest(F.lit(min_films) - F.col("n"), F.lit(0)).cast("bigint").alias("violations")
    )
    return (
        rows.unionByName(crowded.select(F.lit("reviews per group within cap").alias("rule"), "violations"))
        .unionByName(films.select(F.lit("enough films").alias("rule"), "violations"))
    )


# -- slices of a scored table ---------------------------------------------- #
def by_slice(scored: DataFrame, column: str) -> DataFrame:
    """Accuracy per value of any column (a rating, a language)."""
    return scored.groupBy(column).agg(
        F.count("*").alias("n"), F.avg(right()).alias("accuracy"), F.avg("score").alias("mean_score"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
    )


def by_rating(scored: DataFrame, rating: str = "rating") -> DataFrame:
    """Accuracy per star rating, whose gold label follows from the stars."""
    return scored.groupBy(F.col(rating).alias("star_rating")).agg(
        F.when(F.min("label") == 1, LABEL_NAMES[1]).otherwise(LABEL_NAMES[0]).alias("gold_label"),
        F.count("*").alias("n"), F.avg(right()).alias("accuracy"), F.avg("score").alias("mean_model_score"),
    )


def by_length(scored: DataFrame, words: str = "words", n_bins: int = 5) -> DataFrame:
    """Accuracy per length quantile; bins are right-closed, the first takes its edge."""
    cuts = [i / n_bins for i in range(1, n_bins)]
    edges = scored.agg(F.percentile(words, F.array(*[F.lit(c) for c in cuts])).alias("e")).scalar()
    n = F.col(words).cast("double")
    name = F.lit(f"Q{n_bins}")
    for i in reversed(range(n_bins - 1)):
        name = F.when(n <= F.get(edges, i), F.lit(f"Q{i + 1}")).otherwise(name)
    return scored.groupBy(name.alias("length_bin")).agg(
        F.min(words).alias("min_words"), F.max(words).alias("max_words"),
        F.percentile(words, F.lit(0.5)).alias("median_words"),
        F.count("*").alias("n"), F.avg(right()).alias("accuracy"),
    )


def by_construction(scored: DataFrame, probes=PROBES, text: str = "text") -> DataFrame:
    """Accuracy with and without each construction.

    Uses flag columns named after the probes where the table has them, so the
    texts need not travel to the scores.
    """
    ready = all(name in scored.columns for name, _ in probes)
    flags = [F.col(name) for name, _ in probes] if ready else probe_flags(F.col(text), probes)
    flagged = scored.select(right().alias("_right"), *flags)
    stacked = flagged.select("_right", F.inline(F.array(*[
        F.struct(F.lit(name).alias("construction"), F.col(name).alias("present")) for name, _ in probes
    ])))
    present = F.col("present")
    out = stacked.groupBy("construction").agg(
        (F.avg(present.cast("double")) * F.lit(100.0)).alias("share_pct"),
        F.avg(F.when(present, F.col("_right"))).alias("accuracy_present"),
        F.avg(F.when(~present, F.col("_right"))).alias("accuracy_absent"),
        F.avg("_right").alias("overall_accuracy"),
    )
    delta = (F.col("accuracy_present") - F.col("accuracy_absent")) * F.lit(100.0)
    return out.withColumn("delta_pp", delta)


def confident_errors(scored: DataFrame, texts: DataFrame, n: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """The wrong predictions made with most confidence, with the start of the text.

    The n rows are chosen first; only they meet ``texts`` (doc_id, text).
    """
    wrong = scored.filter(F.col("pred") != F.col("label")).withColumn(
        "confidence", F.round(confidence(F.col("score")), 9)
    )
    worst = settle(wrong.orderBy(F.desc("confidence"), "doc_id").limit(n).select(
        "doc_id", *keep, "label", "pred", "score", "confidence"
    ), "worst")
    return lookup(texts, worst, ["doc_id"]).select(
        *worst.columns, F.substring("text", 1, 400).alias("text")
    )


# -- experiments ----------------------------------------------------------- #
def learning_curve(runs: DataFrame) -> DataFrame:
    """``model, train_size`` summary of runs (accuracy, n_features, parameter)."""
    return runs.groupBy("model", "train_size").agg(
        F.count("*").alias("repeats"), F.avg("accuracy").alias("accuracy_mean"),
        F.min("accuracy").alias("accuracy_min"), F.max("accuracy").alias("accuracy_max"),
        F.stddev_pop("accuracy").alias("accuracy_std"), F.avg("n_features").alias("n_features_mean"),
        F.percentile("parameter", F.lit(0.5)).alias("median_parameter"),
    )


def curve_pivot(curve: DataFrame, models: list[str]) -> DataFrame:
    return curve.groupBy("train_size").pivot("model", models).agg(F.first("accuracy_mean"))


def label_efficiency(curve: DataFrame) -> DataFrame:
    """Each size of the model that is best at full size, relative to full size."""
    best = curve.orderBy(F.desc("train_size"), F.desc(F.round("accuracy_mean", 9)), "model").limit(1)
    chosen = curve.join(best.select("model"), "model", "left_semi")
    top = curve.agg(F.max(F.struct("train_size", F.round("accuracy_mean", 9).alias("a"))).alias("t")).scalar()
    return chosen.select(
        "model", "train_size", F.col("accuracy_mean").alias("accuracy"),
        (F.lit(100.0) * F.col("accuracy_mean") / top["a"]).alias("share_of_full_pct"),
        (F.lit(100.0) * F.col("train_size").cast("double") / top["train_size"].cast("double")).alias("label_cost_pct"),
    )


def transfer_table(metrics: DataFrame, reference: DataFrame) -> DataFrame:
    """Gap between transfer accuracy and the reference of the target corpus."""
    joined = metrics.join(reference, "evaluated_on")
    gap = (F.col("reference_accuracy") - F.col("accuracy")) * F.lit(100.0)
    return joined.withColumn("gap_pp", gap)
