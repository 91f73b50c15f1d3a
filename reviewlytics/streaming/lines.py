"""Reviews that arrive as lines, scored as they come.

The batch counterpart reads lines from standard input. Every line is one
review; its own terms are summed inside its row, so the stream keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.system import SentimentSystem


def review_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines of the files that appear in ``folder``."""
    return spark.readStream.text(folder).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")


def score_stream(lines: DataFrame, system: SentimentSystem, out: str, checkpoint: str):
    """Score each micro-batch with the batch operators and append it to Parquet."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again after a failure overwrites its own folder.
        keyed = batch.withColumn("doc_id", F.sha2("text", 256)).dropDuplicates(["doc_id"])
        scored = system.score(keyed)
        batch.withColumn("doc_id", F.sha2("text", 256)).join(scored, "doc_id").write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
