"""From raw documents to packed sequences: the stages and the run over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.llm import exact_dedup, near_dedup, packing, quality_rules, substring_dedup
from reviewlytics.llm.rows import NO_ID, replaced, row_key
from reviewlytics.runtime import release, settle, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Stages use tokenizers and word-sequence hashes, which SQL cannot express; the tests compare with a plain version.
ORACLE_SQL = None


def _one_per_group(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs`` per group of ``members`` (doc, tag, group): its candidates are given, the least key among them stays.

    Rows that share that key are whole repeats of id and text; the least of
    them stays. Most keys have one candidate and need no look at their rows.
    """
    chosen = members.groupBy("group").agg(F.min(F.struct("doc", "tag")).alias("key"), F.count(F.lit(1)).alias("n"))
    chosen = settle(chosen.select(F.col("key.doc").alias("__doc"), F.col("key.tag").alias("__tag"), "n"), "chosen")
    sole = replaced(docs, "doc_id", "text", chosen.filter("n = 1").drop("n"), "left_semi")
    several = chosen.filter("n > 1").select("__doc", "__tag")
    doc, tag = row_key("doc_id", "text")
    rows = replaced(docs, "doc_id", "text", several, "left_semi").select(doc.alias("__doc"), tag.alias("__tag"), F.struct(*docs.columns).alias("__row"))
    return sole.union(rows.groupBy("__doc", "__tag").agg(F.min("__row").alias("__row")).select("__row.*"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rules, or the rules for their host, refuse go. Null, empty and blank texts are refused; repeats of a kept row are kept here."""
    verdicts = quality_rules.quality_verdicts(docs).filter("kept")
    kept = verdicts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__doc"), F.col("tag").alias("__tag"))
    return replaced(docs, "doc_id", "text", kept.distinct(), "left_semi")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: of the largest id, then of the least tag."""
    release(spark)
    kept = exact_dedup.exact_groups(docs).filter("kept")
    return _one_per_group(docs, kept.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "tag", F.col("text_sha256").alias("group")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five-word shingles, similarity 0.8) one row stays: of the least id, then of the least tag.

    Texts without words are no near-copies: of these only whole repeats go.
    """
    release(spark)
    members = near_dedup.near_members(docs).filter("doc = component")
    has = F.col("n") > 0
    group = F.struct(has.alias("has"), F.coalesce("group", "doc").alias("a"), F.when(has, 0).otherwise(F.col("tag")).alias("b"))
    return _one_per_group(docs, members.select("doc", "tag", group.alias("group")))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows go; a text that loses any has its other words left, joined by blanks.

    No row goes, null and empty texts and null ids included; a text that is all
    repeats becomes empty. Other columns stay, ``n_chars`` is counted anew.
    """
    release(spark)
    found = substring_dedup.substring_dedup(docs).filter("n_removed > 0").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__doc"), F.col("tag").alias("__tag"), F.col("kept_text").alias("__text"),
    )
    found = settle(found, "cut-texts")
    # The join moves all texts once more; those of the search and its windows are done with.
    release(spark)
    joined = replaced(docs, "doc_id", "text", found.dropDuplicates(["__doc", "__tag"]))
    changed = joined.withColumn("text", F.coalesce("__text", "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("__text").isNotNull(), F.length("__text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 2048 tokens; null and empty texts are one end id. An empty table gives no rows."""
    release(spark)
    return packing.pack(docs, TOKENIZER).drop("tag")


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("substring dedup", substrings),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
