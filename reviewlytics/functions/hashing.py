"""Seeded randomness from hashes: the same on any partitioning, in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed, *keys) -> Column:
    """32 hex digits that depend only on the seed and the keys."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_number(digest: Column) -> Column:
    """The first eight hex digits as a number in [0, 2^32)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_fraction(digest: Column) -> Column:
    return hash_number(digest).cast("double") / F.lit(4294967296.0)
