"""The deployed system: a recipe and a fitted model, for whole tables of reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.operators import linear, verdict
from reviewlytics.operators.linear import LinearModel
from reviewlytics.operators.models import predict
from reviewlytics.operators.normalise import Recipe, normalise


@dataclass
class SentimentSystem:
    """Scores, explains and pools reviews (``doc_id, text, ...``)."""

    model: LinearModel
    recipe: Recipe
    lemmas: DataFrame | None = None

    def save(self, path: str) -> None:
        self.model.meta["recipe"] = self.recipe.to_dict()
        self.model.save(path)
        if self.lemmas is not None:
            self.lemmas.write.mode("overwrite").parquet(f"{path}/lemmas")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SentimentSystem":
        model = LinearModel.load(spark, path)
        recipe = Recipe(**model.meta["recipe"])
        lemmas = spark.read.parquet(f"{path}/lemmas") if recipe.normalisation == "lemma" else None
        return SentimentSystem(model, recipe, lemmas)

    def tokens(self, reviews: DataFrame) -> DataFrame:
        return normalise(reviews, self.recipe, lemmas=self.lemmas)

    def score(self, reviews: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``doc_id, keep..., score, pred, sentiment, confidence``."""
        scored = predict(self.tokens(reviews), self.model, keep or [])
        return scored.withColumns({
            "sentiment": linear.sentiment(F.col("score")), "confidence": linear.confidence(F.col("score")),
        })

    def explain(self, reviews: DataFrame, n: int = 8) -> DataFrame:
        docs = self.tokens(reviews).withColumn("fit", F.lit("all"))
        return linear.explain(docs, self.model, n).drop("fit")

    def judge_films(self, reviews: DataFrame, method: str = "majority", film: str = "film_id", **options) -> DataFrame:
        return verdict.film_verdicts(self.score(reviews, [film]), method, film, **options)

    def compare_rules(self, reviews: DataFrame, film: str = "film_id", **options) -> DataFrame:
        return verdict.compare_rules(self.score(reviews, [film]), film, **options)
