"""How far the word use of each source lies from the others of its language, in whole numbers.

All pairs of groups and all terms make a cube. It is cut along its three axes
into cells of two blocks of groups and one block of terms. The counts of a
group block and term block, a slice, are sent to every cell that needs them; a
cell adds up what its terms contribute to the divergence of each of its pairs;
a last sum over the term blocks gives the whole. A cell holds a bounded number
of groups and about as many terms as it is told, however large a group is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.llm.rows import pieces
from reviewlytics.runtime import lookup, settle, ship_package

#: Shares are counted in billionths.
SCALE = 1_000_000_000
#: Groups and terms in a block, on average: a cell's table is some 4 MB.
GROUP_BLOCK, TERM_BLOCK = 64, 4096
#: Counts that a task holds before it sends them on.
HELD = 1 << 18
SLICE_BYTES = 4 << 20

# Terms are letters A to Z and all that is not ASCII, which in UTF-8 are these bytes.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
_LOWER = bytes(range(256)).lower()


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices that end between terms."""
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and texts, added up within the task."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        langs, sources, terms, ns, docs = [], [], [], [], []
        for (lang, source), (n, d) in counts.items():
            langs += [lang] * len(n)
            sources += [source] * len(n)
            terms += n
            ns += n.values()
            docs += map(d.__getitem__, n)
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()), pa.array(docs, pa.int64())],
            ["lang", "source", "term", "n", "docs"],
        )

    for batch in pieces(batches):
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for part in _slices(text):
                terms = _TERM.findall(part.translate(_LOWER))
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n) - before
            if held > HELD:
                yield flush()
                held = 0
    if held:
        yield flush()


def _share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / whole); decimals, as the product can pass 64 bits."""
    up = (n + F.lit(1)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, whole.cast("decimal(20,0)")) + F.lit(1)


def _cell(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """The contributions of a block of terms to the divergences of two blocks of groups."""
    _lang, a, b, _t = key
    kind = rows["kind"].to_numpy()
    heads = rows[kind == 0].sort_values("g", ignore_index=True)
    number, p0, block = heads["g"].to_numpy(), heads["p"].to_numpy(), heads["term"].to_numpy()
    own = rows[kind == 1]
    terms, column = np.unique(own["term"].to_numpy(), return_inverse=True)
    share = np.repeat(p0[:, None], len(terms), axis=1)
    share[np.searchsorted(number, own["g"].to_numpy()), column.reshape(-1)] = own["p"].to_numpy()
    # Terms of the block that no group here has: all are alike for a pair.
    absent = int(rows["p"].to_numpy()[kind == 2].sum()) - len(terms)
    share, weight = np.column_stack((share, p0)), np.append(np.ones(len(terms), np.int64), absent)
    one, two = np.flatnonzero(block == a), np.flatnonzero(block == b)
    out = []
    for i in one.tolist():
        square = (share[i] - share[two]) ** 2
        out.append((np.full(len(two), number[i]), number[two], (square // share[two]) @ weight))
        if a != b:
            out.append((number[two], np.full(len(two), number[i]), (square // share[i]) @ weight))
    g, s, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    apart = g != s
    return pd.DataFrame({"g": g[apart], "s": s[apart], "value": value[apart]})


def _pairs(groups: DataFrame, shares: DataFrame, blocks: DataFrame) -> DataFrame:
    """``g``, ``s``, ``value`` for all ordered pairs of groups of a language.

    ``groups``: lang, g, p0, x, n_x (its block, of how many), n_t; ``shares``:
    lang, g, x, n_x, term, t, p; ``blocks``: lang, t, n_x, n_terms.
    """
    with_all = F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)).alias("y")
    cell = ["lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "t"]
    heads = groups.select("*", with_all).select("*", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1)).alias("t"))
    heads = heads.select(*cell, F.lit(0).alias("kind"), "g", F.col("x").cast("bigint").alias("term"), F.col("p0").alias("p"))
    slices = shares.select("*", with_all).select(*cell, F.lit(1).alias("kind"), "g", "term", "p")
    sizes = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)).alias("x")).select("*", with_all).filter("x <= y")
    none = F.lit(None).cast("bigint")
    sizes = sizes.select(*cell, F.lit(2).alias("kind"), none.alias("g"), none.alias("term"), F.col("n_terms").alias("p"))
    # Only these rows have no group: 0 keeps the column a whole number in the cell.
    cells = heads.union(slices).union(sizes).fillna(0, ["g", "term"])
    parts = cells.groupBy("lang", "a", "b", "t").applyInPandas(_cell, "g long, s long, value long")
    return parts.groupBy("g", "s").agg(F.sum("value").alias("value"))


def divergence_audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = 3, top_terms: int = 200, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
) -> DataFrame:
    """Divergences of each (lang, source) group: lang, source, part, item, value, rank.

    Terms are runs of letters A-Z and non-ASCII characters, A-Z lower-cased.
    A language keeps the V terms that ``least_docs`` of its texts hold. A group
    of N occurrences of these gives each a share of 1 + floor(10**9 * (count +
    1) / (N + V)). Part ``pair``: items are the other sources of the language,
    the value is the sum of floor((p - q)**2 / q) over all kept terms, with the
    group's share p and the other's q. Part ``term``: items are the group's
    terms whose share passes that in the whole language, the value is the same
    term, and ranks go to ``top_terms``. Ranks count from 1, larger values
    first, ties by the item's UTF-8.

    Null texts, languages and sources count as empty ones. Groups without terms
    have pairs and no terms; a language without kept terms has pairs of value
    0. Repeated rows count as often as they stand there; an id is not looked
    at, nor are extra columns. An empty table gives no rows.

    Counts leave their task added up. Groups meet in cells only, and no group
    is gathered anywhere; a group's terms are cut to ``top_terms`` before they
    are shuffled.
    """
    ship_package(docs.sparkSession)
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    own = docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text"))
    rows = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = settle(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs)
    kept = settle(kept.select("lang", F.col("term").alias("word"), "lang_n", F.monotonically_increasing_id().alias("term")), "kept-terms")
    found = counts.select("lang", "source", F.col("term").alias("word"), "n").join(kept.hint("merge"), ["lang", "word"])
    found = settle(found, "kept-counts")

    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_all"), F.count(F.lit(1)).alias("v"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    langs = settle(sources.join(langs, "lang", "left").fillna(0).select(
        "lang", "lang_all", "v", F.ceil(F.col("n_sources") / group_block).cast("int").alias("n_x"),
        F.greatest(F.ceil(F.col("v") / term_block), F.lit(1)).cast("int").alias("n_t"),
    ), "languages")
    groups = lookup(groups.fillna(0, ["n_all"]), langs, ["lang"])
    whole = F.greatest(F.col("n_all") + F.col("v"), F.lit(1))
    groups = settle(groups.select(
        "lang", "source", "n_all", "v", "n_x", "n_t", F.pmod(F.xxhash64("source"), F.col("n_x")).cast("int").alias("x"),
        _share(F.lit(0), whole).alias("p0"), F.monotonically_increasing_id().alias("g"),
    ), "groups")
    block = F.pmod(F.xxhash64("term"), F.col("n_t")).cast("int").alias("t")
    shares = lookup(found, groups, ["lang", "source"]).select(
        "lang", "source", "g", "x", "n_x", "n_t", "term", "word", "lang_n", "v", _share(F.col("n"), F.col("n_all") + F.col("v")).alias("p"), block,
    )
    blocks = lookup(kept, langs, ["lang"]).select("lang", "n_x", block).groupBy("lang", "n_x", "t").agg(F.count(F.lit(1)).alias("n_terms"))

    pairs = _pairs(groups, shares, blocks)
    names = groups.select("g", "lang", "source")
    pairs = lookup(lookup(pairs, names, ["g"]), names.select(F.col("g").alias("s"), F.col("source").alias("item")), ["s"])
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    apart = lookup(shares.drop("n_x", "n_t", "v"), langs.select("lang", "lang_all", "v"), ["lang"])
    apart = apart.withColumn("q", _share(F.col("lang_n"), F.col("lang_all") + F.col("v"))).filter("p > q")
    # Squares of shares stay below 2**63.
    apart = apart.select("lang", "source", F.lit("term").alias("part"), F.col("word").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(apart)
