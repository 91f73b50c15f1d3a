"""The queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.functions.text import let
from reviewlytics.llm import (
    bpe, chunked_bpe, divergence, exact_dedup, license_scan, line_dedup, lm_scores, near_dedup, packing, periodic_runs,
    quality_rules, substring_dedup, wavelet,
)
from reviewlytics.llm import sql as llm_sql
from reviewlytics.llm.rows import given_id
from reviewlytics.runtime import settle, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    # The written ids let encoding and decoding take turns in the workers' memory.
    tokens = bpe.bpe_decode(settle(bpe.bpe_encode(table(spark, folder, "documents"), TOKENIZER), "token-ids"), TOKENIZER)
    return tokens.select(
        given_id().alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents")).drop("tag")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER).drop("tag")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, folder, "documents")).drop("tag")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).drop("tag")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = wavelet.token_folder(spark)
    wavelet.write_tokens(table(spark, folder, "documents"), TOKENIZER, path)
    return wavelet.read_tokens(spark, path).drop("tag")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.quality_verdicts(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    found = lm_scores.cross_entropy_difference(table(spark, folder, "documents"), good)
    losses = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("target_loss", "background_loss", "difference")]
    return found.select("doc_id", "n_tokens", *losses)


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"), shingle=2).drop("tag")


def op11_chunked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coder = (RANKS, public_tokenizers.PATTERN)
    # The written ids let encoding and decoding take turns in the workers' memory.
    tokens = chunked_bpe.decode(settle(chunked_bpe.chunked_encode(table(spark, folder, "documents"), *coder), "token-ids"), *coder)
    return tokens.select(
        given_id().alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, folder, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of some texts, chosen by the id, repeating from some word on. Rows without an id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeating(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return let(F.struct(w.alias("w"), a.alias("a"), p.alias("p"), n.alias("n")), lambda x: F.concat(
            F.slice(x["w"], F.lit(1), x["a"]),
            F.transform(F.sequence(F.lit(0), x["n"] - x["a"] - 1), lambda i: F.get(x["w"], x["a"] + i % x["p"])),
        ))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(repeating(w), " ")).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return found.withColumn("best", periodic_runs.strongest()).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_QUERIES = (
    op1_substring_dedup, op2_bpe, op3_license_scan, op4_best_fit_packing, op5_line_dedup, op6_exact_dedup, op7_token_files,
    op8_quality_rules, op9_lm_scores, op10_near_dedup, op11_chunked_bpe,
    op12_divergence_audit, op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(llm_sql.QUERIES)
