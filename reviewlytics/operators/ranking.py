"""Exact numbering and running sums without a single-task window.

Every window below is partitioned by a bucket of bounded size; the buckets are
tied together by offsets, which are sums over a small bucket table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.functions.hashing import seeded_hash
from reviewlytics.runtime import settle

SCORE_DIGITS = 9
SCORE_BUCKETS = 4096


def rank_by_hash(
    df: DataFrame, by: list[str], key: str, seed, out: str = "rank", size: str | None = None
) -> DataFrame:
    """Number rows 1, 2, ... within ``by`` in the order of ``md5(seed:key)``.

    ``size`` names a column for the number of rows of the group.

    The leading three hex digits split each group into 4,096 even buckets, so
    a group that holds most of the table is still numbered by many tasks.
    ``key`` must be unique within a group.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, key)).withColumn("_b", F.substring("_h", 1, 3))
    within = Window.partitionBy(*by, "_b").orderBy("_h", key)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(*by)).alias(size)] if size else []
    offsets = (
        hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
        .select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *whole)
    )
    return (
        hashed.withColumn("_r", F.row_number().over(within))
        .join(offsets, [*by, "_b"])
        .withColumn(out, (F.col("_before") + F.col("_r")).cast("bigint"))
        .drop("_h", "_b", "_r", "_before")
    )


def rank_by_range(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Number rows within ``by`` in any order: range-partition, count, offset.

    The range-partitioned rows are written first, so that both passes see the
    same partitions even if tasks are run again.
    """
    keys = [F.col(k) for k in by]
    parted = settle(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
        .select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    return (
        parted.withColumn("_r", F.row_number().over(within))
        .join(offsets, [*by, "_part"])
        .withColumn(out, (F.col("_before") + F.col("_r")).cast("bigint"))
        .drop("_part", "_r", "_before")
    )


def rounded_score(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def score_bucket(score: Column) -> Column:
    """Equal-width bucket of a score in [0, 1].

    With nine digits kept there are at most 244,141 distinct scores in each.
    """
    return F.floor(score * F.lit(float(SCORE_BUCKETS))).cast("int")


def running_totals(
    rows: DataFrame, by: list[str], score: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """One row per (group, distinct score): its sums and the sums before it.

    Equal scores are combined first, in the map tasks already, so a score that
    many rows share costs one row. For each column ``s`` of ``sums`` the result
    has ``s`` and ``s_before``, plus ``s_total`` for the whole group.
    """
    distinct = rows.groupBy(
        *by, score_bucket(F.col(score)).alias("_bucket"), score
    ).agg(*[F.sum(s).alias(s) for s in sums])
    direction = F.desc if descending else F.asc
    within = (
        Window.partitionBy(*by, "_bucket").orderBy(direction(score))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*by).orderBy(direction("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    buckets = (
        distinct.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            *by, "_bucket",
            *[F.coalesce(F.sum(s).over(across), F.lit(0)).alias(f"_{s}_offset") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
        )
    )
    inside = distinct.select(
        "*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"_{s}_inside") for s in sums]
    )
    return inside.join(buckets, [*by, "_bucket"]).select(
        *by, "_bucket", score,
        *sums,
        *[(F.col(f"_{s}_offset") + F.col(f"_{s}_inside")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )
