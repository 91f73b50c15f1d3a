"""Exact dedup by naming: equal texts get one integer name, other texts never do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.rows import given_id, keyed
from reviewlytics.runtime import settle

BLOCK_CHARS = 4096


def _integer_names(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Each row's number in its sorted partition, apart from those of other partitions.

    Numbers hold only once written: every use must be of the settled table.
    """
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def text_blocks(own: DataFrame, block_chars: int) -> DataFrame:
    """Blocks of all texts with two hashes each; ``row`` tells rows apart, whatever their ids, once it is written.

    Most texts are one block and are not searched for others.
    """
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    parts = F.when(F.length("text") <= block_chars, F.array("text")).otherwise(cut)
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc", "tag", F.sha2("text", 256).alias("sha"), parts.alias("parts"))
    blocks = rows.select("row", "doc", "tag", "sha", F.size("parts").alias("n_blocks"), F.posexplode("parts").alias("i", "block"))
    return blocks.withColumns({"h1": F.xxhash64("block"), "h2": F.xxhash64(F.lit(7), "block")})


def _block_names(blocks: DataFrame) -> DataFrame:
    """``row``, ``doc``, ``tag``, ``sha``, ``n_blocks``, ``i``, ``name``: equal contents have equal names, others differ.

    Texts are read twice, once for what is known of each block and once for
    contents, which are shuffled once, one row per map task and content;
    grouping compares them in full. Positions find their name by two hashes of
    the content. Should these ever be equal for two contents, positions find it
    by the content itself.
    """
    address = ["h1", "h2"]
    first = F.when(F.col("i") == 0, F.col("sha")).alias("sha")
    places = settle(blocks.select("row", "doc", "tag", first, "n_blocks", "i", *address), "blocks")
    named = _integer_names(blocks.select(*address, "block").distinct(), ["block"])
    names = settle(named.select(*address, "name"), "block-names")
    if not names.groupBy(*address).count().filter("count > 1").isEmpty():
        places = settle(blocks.select("row", "doc", "tag", first, "n_blocks", "i", *address, "block"), "blocks")
        names, address = settle(named, "block-names"), [*address, "block"]
    return settle(places.join(names, address).drop(*address), "named-blocks")


def text_names(blocks: DataFrame) -> DataFrame:
    """``row``, ``doc``, ``tag``, ``sha``, ``n_blocks``, ``name`` of texts: (n_blocks, name) is equal for equal texts only.

    Blocks of fixed size get names; then, turn by turn, neighbouring names are
    paired and the pairs named, until one name is left per text. A text of
    2**r blocks takes r turns, and takes no part in later ones.
    """
    blocks = _block_names(blocks)
    text = ["row", "doc", "tag", "sha", "n_blocks"]
    done = blocks.filter("n_blocks = 1").select(*text, "name")
    line, width = blocks.filter("n_blocks > 1").select("row", "n_blocks", "i", "name"), 1
    long = None
    while not line.isEmpty():
        odd = F.col("i") % 2 == 1
        pairs = line.groupBy("row", "n_blocks", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = settle(_integer_names(pairs.select("left", "right").distinct(), ["left", "right"]), "pair-names")
        line = settle(pairs.join(names, ["left", "right"]).drop("left", "right"), "named-pairs")
        width *= 2
        ready = line.filter(F.col("n_blocks") <= width).select("row", "name")
        long = ready if long is None else long.union(ready)
        line = line.filter(F.col("n_blocks") > width)
    if long is None:
        return done
    return done.union(blocks.filter("n_blocks > 1 and i = 0").select(*text).join(long, "row").select(*text, "name"))


def normalised(text):
    """Lower case for A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Groups of equal texts: one row per row of ``docs``.

    Columns: doc_id, tag (hash of the given text), keep_id (largest doc_id of
    the group), group_size (rows), kept, text_sha256. Texts are equal when they
    are identical after lower-casing A-Z.

    Null and empty texts form one group. A null id is less than any other, and
    is null in the result; a group of such rows alone keeps them. Rows that
    repeat the largest id stay too. Extra columns are not looked at.
    DataFrame functions only.
    """
    own = keyed(docs, id_col, text_col).withColumn("text", normalised("text"))
    rows = settle(text_names(text_blocks(own, block_chars)), "text-names")
    # Written, so that the join below is one of two tables, whose hot keys adaptive execution deals out.
    groups = rows.groupBy("n_blocks", "name").agg(F.max("doc").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = settle(groups, "text-groups")
    return rows.join(groups, ["n_blocks", "name"]).select(
        given_id().alias("doc_id"), "tag", given_id("keep").alias("keep_id"), "group_size",
        (F.col("doc") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
