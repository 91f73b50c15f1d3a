"""MinHash near-dedup with SuperMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.llm.components import components
from reviewlytics.llm.rows import given_id, keyed, pieces
from reviewlytics.llm.shingles import fingerprints, shingle_sets
from reviewlytics.llm.superminhash import band_keys, signatures
from reviewlytics.runtime import settle, ship_package

#: At a similarity of 0.8 a pair of sets shares no band with a probability of 7e-6.
SLOTS, BANDS = 150, 30
HEADS = 4
HEAD_BATCH, MEMBER_BLOCK = 128, 256


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        hashes, first = shingle_sets(batch["text"], size)
        one, two = fingerprints(hashes, first)
        keys = band_keys(signatures(hashes, first, SLOTS), BANDS).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            batch["doc"], batch["tag"], pa.array(np.diff(first)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
        ], ["doc", "tag", "n", "fp1", "fp2", "keys"])


def _groups(batches: Iterator[pa.RecordBatch], size: int):
    """Whole groups: (first band key, heads, members), each a list of (node, comp, keys, set)."""
    now, heads, members = None, [], []
    for batch in pieces(batches):
        hashes, first = shingle_sets(batch["text"], size)
        cols = [batch[c].to_pylist() for c in ("g", "batch", "block", "head", "node", "comp", "bucket")]
        keys = np.asarray(batch["keys"].flatten()).reshape(batch.num_rows, -1)
        for i, (g, b, k, head, node, comp, bucket) in enumerate(zip(*cols, strict=True)):
            if (g, b, k) != now:
                if heads and members:
                    yield heads, members
                now, heads, members = (g, b, k), [], []
            (heads if head else members).append((node, comp, bucket, keys[i], hashes[first[i] : first[i + 1]]))
    if heads and members:
        yield heads, members


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The links between heads and members of each group, by their full sets."""
    out: list[tuple[int, int]] = []
    for heads, members in _groups(batches, size):
        node = np.array([m[0] for m in members])
        comp = np.array([m[1] for m in members])
        keys = np.array([m[3] for m in members])
        sizes = np.array([len(m[4]) for m in members])
        for h, c, bucket, k, own in heads:
            n = len(own)
            test = (comp != c) & (node != h) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            if bucket is not None and test.any():
                same = keys == k
                test &= same.any(axis=1) & (k[same.argmax(axis=1)] == bucket)
            test = np.flatnonzero(test)
            if not len(test):
                continue
            every = np.concatenate([members[i][4] for i in test])
            found = own[np.minimum(np.searchsorted(own, every), n - 1)] == every
            both = np.add.reduceat(found.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[test])[:-1])))
            linked = 100 * both >= percent * (sizes[test] + n - both)
            out.extend((h, int(x)) for x in node[test[linked]])
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


def _links(groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``groups`` (g, batch, block, head, node, comp, bucket) are joined with the texts, dealt out and verified."""
    rows = groups.join(texts, "node").repartition("g", "batch", "block").sortWithinPartitions("g", "batch", "block")
    return settle(rows.mapInArrow(partial(_verify, size=shingle, percent=percent), "a long, b long"), "near-links")


def _by_head(pairs: DataFrame) -> DataFrame:
    """Pairs (lead, node) as groups of one head and at most about MEMBER_BLOCK members."""
    counts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("blocks"))
    members = pairs.join(counts, "lead").select(
        F.col("lead").alias("g"), F.pmod(F.hash("node"), F.col("blocks")).alias("block"), F.lit(False).alias("head"), "node",
    )
    heads = counts.select(
        F.col("lead").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(True).alias("head"), F.col("lead").alias("node"),
    )
    # One pair per row has been picked already: give both sides components that differ.
    return members.union(heads).select(
        "g", F.lit(0).alias("batch"), "block", "head", "node", F.col("head").cast("bigint").alias("comp"),
        F.lit(None).cast("bigint").alias("bucket"),
    )


def _in_buckets(rest: DataFrame) -> DataFrame:
    """Buckets with members of several components: those outside the bucket's largest one, against all."""
    sizes = rest.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    most = sizes.groupBy("bucket").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"), F.max("n").alias("top"),
    ).filter(F.col("all") > F.col("top"))
    most = most.select(
        "bucket", "most",
        F.ceil((F.col("all") - F.col("top")) / HEAD_BATCH).cast("int").alias("batches"),
        F.ceil(F.col("all") / MEMBER_BLOCK).cast("int").alias("blocks"),
    )
    rows = rest.join(most, "bucket").select(
        "bucket", "node", "comp", "most", "batches", "blocks",
        F.pmod(F.hash("node"), F.col("batches")).alias("batch"), F.pmod(F.hash("node"), F.col("blocks")).alias("block"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    heads = rows.filter("comp != most").select("bucket", "batch", every("blocks").alias("block"), F.lit(True).alias("head"), "node", "comp")
    members = rows.select("bucket", every("batches").alias("batch"), "block", F.lit(False).alias("head"), "node", "comp")
    return heads.union(members).select(F.col("bucket").alias("g"), "batch", "block", "head", "node", "comp", "bucket")


def _labelled(entries: DataFrame, links: DataFrame) -> DataFrame:
    comps = components(links, "a", "b")
    return entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of texts whose shingle sets are alike: one row per row of ``docs``.

    Columns: doc, tag (the row key), n (shingles), group (a number, null for
    texts without shingles), component (least doc reachable over links). Groups
    may share a component where ids repeat or are null; their numbers differ.
    Two sets are linked if 100 * intersection >= percent * union.

    1. Each text becomes a set of shingle hashes, 128 bits that identify the
       set, a SuperMinHash signature of 150 slots and its 30 band keys. Texts
       with one set are one node from here on, however many there are.
    2. Nodes that share a band key share a bucket. In each bucket all members
       are verified against its least node, then, where several components
       are left, against its four nodes of most links, and last all members
       outside the largest component against all. Members of one component
       need no test among themselves, so no link is lost and a group of m
       copies costs about m tests.
    3. Verification counts full sets, in blocks of a bounded number of texts.

    Null, empty and blank texts have no shingles and are alone; null ids count
    as one id below all others and come back as null. Rows that repeat id and
    text get equal results. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = keyed(docs, id_col, text_col)
    rows = settle(own.mapInArrow(partial(_sign, size=shingle), "doc long, tag long, n long, fp1 long, fp2 long, keys array<long>"), "signatures")
    sets = settle(
        rows.filter("n > 0").groupBy("fp1", "fp2")
        .agg(F.min("doc").alias("low"), F.min(F.struct("doc", "tag")).alias("rep"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()), "sets",
    )
    entries = sets.select("node", F.explode("keys").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("lead")).filter("m > 1")
    entries = settle(entries.join(shared.drop("m"), "bucket"), "buckets")
    chosen = sets.join(entries.select("node").distinct(), "node", "left_semi").select("node", "rep.doc", "rep.tag", "keys")
    texts = settle(own.join(chosen, ["doc", "tag"]).select("node", "keys", "text").dropDuplicates(["node"]), "near-texts")

    verified = partial(_links, texts=texts, shingle=shingle, percent=percent)
    links = verified(_by_head(entries.filter("node != lead").select("lead", "node").distinct()))
    rest = settle(_labelled(entries.filter("node != lead").drop("lead"), links), "buckets")
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    rest = rest.join(mixed, "bucket", "left_semi")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    order = Window.partitionBy("bucket").orderBy(F.col("degree").desc_nulls_last(), "node")
    heads = settle(
        rest.join(degree, "node", "left").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HEADS)
        .select("bucket", F.col("node").alias("lead"), F.col("comp").alias("lead_comp")), "heads",
    )
    pairs = rest.join(heads, "bucket").filter("comp != lead_comp").select("lead", "node").distinct()
    links = links.union(verified(_by_head(pairs)))
    rest = rest.drop("comp").join(heads.select("bucket", F.col("lead").alias("node")), ["bucket", "node"], "left_anti")
    links = links.union(verified(_in_buckets(_labelled(rest, links))))

    comps = components(links, "a", "b")
    nodes = sets.select("fp1", "fp2", "low", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = settle(nodes, "nodes")
    lowest = nodes.groupBy("comp").agg(F.min("low").alias("component"))
    found = rows.drop("keys").join(
        nodes.join(lowest, "comp").select("fp1", "fp2", F.col("comp").alias("group"), "component"), ["fp1", "fp2"], "left",
    )
    return found.select("doc", "tag", "n", "group", F.coalesce("component", "doc").alias("component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``near_members`` by given ids: doc_id, tag (hash of the text), n_shingles, component_id, kept (doc_id = component_id)."""
    return near_members(docs, id_col, text_col, shingle, percent).select(
        given_id().alias("doc_id"), "tag", F.col("n").alias("n_shingles"), given_id("component").alias("component_id"),
        (F.col("component") == F.col("doc")).alias("kept"),
    )
