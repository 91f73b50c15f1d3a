"""Seeded splits, folds, subsamples and orders, decided by hashes of the key.

No operator depends on how rows are partitioned. Ranks come from
:func:`reviewlytics.operators.ranking.rank_by_hash`, so a class that holds
nearly all rows is still ranked by many tasks. Pass narrow tables (key and
label) and join the texts afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.config import SEED
from reviewlytics.functions.hashing import hash_fraction, seeded_hash
from reviewlytics.operators.ranking import rank_by_hash


def stratum_ranks(df: DataFrame, label: str = "label", key: str = "doc_id", seed=SEED) -> DataFrame:
    """Add ``stratum_rank`` (1, 2, ... in hash order) and ``stratum_size`` per class.

    Splits and folds are functions of these two, so texts that carry them are
    split again and again without another shuffle.
    """
    return rank_by_hash(df, [label], key, seed, "stratum_rank", "stratum_size")


def split_part(test_share: float = 0.2) -> Column:
    """``test`` for exactly the rounded share of every class, else ``train``."""
    quota = F.floor(F.col("stratum_size") * F.lit(test_share) + F.lit(0.5))
    return F.when(F.col("stratum_rank") <= quota, "test").otherwise("train")


def fold_number(k: int) -> Column:
    """0..k-1, every class spread evenly."""
    return ((F.col("stratum_rank") - 1) % k).cast("int")


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "doc_id", test_share: float = 0.2, seed=SEED
) -> DataFrame:
    """Add ``part``."""
    ranked = stratum_ranks(df, label, key, seed)
    return ranked.withColumn("part", split_part(test_share)).drop("stratum_rank", "stratum_size")


def threshold_split(df: DataFrame, key: str = "doc_id", test_share: float = 0.2, seed=SEED) -> DataFrame:
    """Add ``part`` by comparing the hash with the share: narrow, no counts.

    The shares hold in expectation, in every class.
    """
    part = F.when(hash_fraction(seeded_hash(seed, key)) < F.lit(test_share), "test").otherwise("train")
    return df.withColumn("part", part)


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "label", key: str = "doc_id", seed=SEED
) -> DataFrame:
    """Add ``fold`` in 0..k-1, every class spread evenly."""
    ranked = rank_by_hash(df, [label], key, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def stratified_subsamples(
    df: DataFrame, draws: dict[int, int], total: int, label: str = "label", key: str = "doc_id", seed=SEED
) -> DataFrame:
    """``train_size, draw`` and the rows drawn for each, by class share.

    ``draws`` holds the number of draws of each size. Sizes at or above
    ``total``, the number of rows, take every row, once.
    """
    plan = [(s, r) for s, n in draws.items() for r in range(1 if s >= total else n)]
    grid = F.inline(F.array(*[
        F.struct(F.lit(s).alias("train_size"), F.lit(r).alias("draw")) for s, r in plan
    ]))
    spread = df.select("*", grid)
    hash_seed = F.concat_ws("/", F.lit(str(seed)), "train_size", "draw")
    ranked = rank_by_hash(spread, ["train_size", "draw", label], key, hash_seed, "_rank", "_n")
    quota = F.floor(F.col("train_size") * F.col("_n").cast("double") / F.lit(float(total)) + F.lit(0.5))
    kept = ranked.filter((F.col("_rank") <= quota) | (F.col("train_size") >= total))
    return kept.drop("_rank", "_n")


def sample_rows(df: DataFrame, n: int, key: str = "doc_id", seed=SEED) -> DataFrame:
    """n rows, all equally likely: the n smallest hashes."""
    return (
        df.withColumn("_h", seeded_hash(seed, key)).orderBy("_h", key).limit(n).drop("_h")
    )


def first_rows(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def shuffled(df: DataFrame, key: str = "doc_id", seed=SEED) -> DataFrame:
    """Add ``position`` 1..n of a seeded random order of the whole table."""
    return rank_by_hash(df, [], key, seed, "position")


def one_per_group(
    df: DataFrame, group: list[str], value: str, key: str = "doc_id", seed=SEED
) -> DataFrame:
    """One random row's value per group: a plain aggregate, safe for any size."""
    order = F.struct(seeded_hash(seed, key), F.col(key))
    return df.groupBy(*group).agg(F.min_by(value, order).alias(value))


def k_per_group(
    df: DataFrame, group: list[str], depths: tuple[int, ...], key: str = "doc_id", seed=SEED
) -> DataFrame:
    """For each k of ``depths`` as column ``k``: min(k, n) random rows per group."""
    ranked = rank_by_hash(df, group, key, seed, "_rank").filter(F.col("_rank") <= max(depths))
    wanted = F.filter(F.array(*[F.lit(k) for k in depths]), lambda k: k >= F.col("_rank"))
    return ranked.select("*", F.explode(wanted).alias("k")).drop("_rank")
