"""Writers for tables, metric records, scored reviews and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.operators.linear import sentiment


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_result_table(df: DataFrame, path: str) -> None:
    """CSV with a header; doubles with four decimals."""
    shown = [
        F.format_string("%.4f", f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per row: metrics, chosen configurations, verdicts."""
    df.write.mode("overwrite").json(path)


def write_scored_reviews(scored: DataFrame, path: str, text: str = "text") -> None:
    """The first 200 characters of each review with its score and sentiment."""
    scored.select(
        F.substring(text, 1, 200).alias("review"), "score", sentiment(F.col("score")).alias("sentiment")
    ).write.mode("overwrite").json(path)


def write_scores(scored: DataFrame, path: str, key: str = "doc_id") -> None:
    scored.select(key, "score").write.mode("overwrite").parquet(path)
