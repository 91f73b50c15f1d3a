"""Connected components of links between numbered nodes, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.runtime import settle


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one piece of the links: each node with the least node of its local group."""
    for links in parts:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(links["u"].tolist(), links["v"].tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
        pairs = [(x, find(x)) for x in list(root)]
        yield pd.DataFrame([(x, r) for x, r in pairs if x != r], columns=["u", "v"], dtype="int64")


def components(links: DataFrame, a: str, b: str, native: bool = False) -> DataFrame:
    """``node``, ``comp``: the least node reachable, for each node that has a link.

    Batches of links shrink to local forests by union-find; large and small
    stars in turn join these, each turn a few shuffles of (node, node) rows,
    until nothing changes. A node of any degree is only ever aggregated, or
    joined to one row. Each turn's links are written to the shared folder.
    ``native`` leaves out the local forests: DataFrame operations only.

    Repeated links, links of a node with itself and links given in both
    directions count as one or none; links with a null end are left out; an
    empty table gives no rows. Extra columns are not looked at.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = settle(links if native else links.mapInPandas(_forest, "u long, v long"), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        before = now
