"""A fitted classifier is a table of term weights; scoring is a join and a sum.

Naive Bayes, both logistic models and the support vector machine all score a
document as ``logistic(bias + sum(x_t * weight_t))`` over its weighted terms,
so they share this one representation, for one model or for many (``keys``).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlytics.config import LABEL_NAMES
from reviewlytics.operators.features import VectorOptions, term_rows, tf_weight
from reviewlytics.runtime import lookup


@dataclass
class LinearModel:
    """``weights``: keys..., term, idf, weight.  ``bias``: keys..., bias."""

    weights: DataFrame
    bias: DataFrame
    keys: list[str]
    options: VectorOptions
    meta: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Two Parquet tables and one JSON record under ``path``."""
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.bias.write.mode("overwrite").parquet(f"{path}/bias")
        record = {"keys": self.keys, "options": asdict(self.options), "meta": self.meta}
        spark = self.weights.sparkSession
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/record")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearModel":
        record = json.loads(spark.read.text(f"{path}/record").first()[0])
        return LinearModel(
            spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/bias"),
            record["keys"], VectorOptions(**record["options"]), record["meta"],
        )


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def score(docs: DataFrame, model: LinearModel, keep: list[str], doc_key: str = "doc_id") -> DataFrame:
    """Add ``score`` in [0, 1] to every document of every fit.

    ``docs`` has the model's keys, ``doc_key``, ``tokens`` and ``keep``. Terms
    meet the weights and are summed in the same task; only one partial sum per
    document is shuffled. Documents without any known term get the bias alone.
    """
    options, keys = model.options, model.keys
    terms = term_rows(docs, [*keys, doc_key, *keep], options.ngram_max, outer=True)
    matched = lookup(terms, model.weights.select(*keys, "term", "idf", "weight"), [*keys, "term"], "left")
    x = tf_weight(F.col("tf"), options) * F.col("idf")
    sums = matched.groupBy(*keys, doc_key, *keep).agg(
        F.coalesce(F.sum(x * F.col("weight")), F.lit(0.0)).alias("_dot"),
        F.coalesce(F.sqrt(F.sum(x * x)), F.lit(1.0)).alias("_norm"),
    )
    dot = F.col("_dot") / F.col("_norm") if options.normalise else F.col("_dot")
    return lookup(sums, model.bias, keys).select(
        *keys, doc_key, *keep, F.round(logistic(F.col("bias") + dot), 9).alias("score")
    )


def with_prediction(scored: DataFrame) -> DataFrame:
    """Threshold at one half; a tie is positive."""
    return scored.withColumn("pred", (F.col("score") >= F.lit(0.5)).cast("int"))


def sentiment(score: Column) -> Column:
    return F.when(score >= F.lit(0.5), LABEL_NAMES[1]).otherwise(LABEL_NAMES[0])


def confidence(score: Column) -> Column:
    return F.abs(score - F.lit(0.5)) * F.lit(2.0)


def top_terms(model: LinearModel, n: int = 20) -> DataFrame:
    """The n most positive and the n most negative terms."""
    rounded = model.weights.select("term", F.round("weight", 9).alias("weight"))
    sides = []
    for side, order in (("positive", F.desc), ("negative", F.asc)):
        sides.append(
            rounded.orderBy(order("weight"), "term").limit(n).select(F.lit(side).alias("side"), "*")
        )
    return sides[0].unionByName(sides[1])


def contributions(docs: DataFrame, model: LinearModel, doc_key: str = "doc_id") -> DataFrame:
    """``x_t * weight_t`` of each known term of each document."""
    options, keys = model.options, model.keys
    terms = term_rows(docs, [*keys, doc_key], options.ngram_max)
    x = tf_weight(F.col("tf"), options) * F.col("idf")
    rows = lookup(terms, model.weights.select(*keys, "term", "idf", "weight"), [*keys, "term"]).withColumn("_x", x)
    if options.normalise:
        doc = Window.partitionBy(*keys, doc_key)
        rows = rows.withColumn("_x", F.col("_x") / F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(doc)))
    return rows.select(*keys, doc_key, "term", F.round(F.col("_x") * F.col("weight"), 9).alias("contribution"))


def explain(docs: DataFrame, model: LinearModel, n: int = 8, doc_key: str = "doc_id") -> DataFrame:
    """The n strongest terms per document and sign, for a whole table.

    Grouped by document, whose size is that of one text.
    """
    rows = contributions(docs, model, doc_key).filter(F.col("contribution") != 0)
    side = F.when(F.col("contribution") > 0, LABEL_NAMES[1]).otherwise(LABEL_NAMES[0])
    rows = rows.withColumn("side", side)
    strongest = Window.partitionBy(*model.keys, doc_key, "side").orderBy(
        F.desc(F.abs("contribution")), "term"
    )
    return rows.withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= n)
