"""Review corpora in their published file layouts, as DataFrames.

Every reader returns at least ``doc_id, text, label``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlytics.config import SEED
from reviewlytics.functions.hashing import seeded_hash
from reviewlytics.runtime import lookup, settle

SPLITS = ("train", "test")
CLASSES = (("neg", 0), ("pos", 1))


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``file, line, value``: the lines of text files with their numbers, from 0. A file may lie in any number of splits.

    Lines are in order within a split. Each split's lines are counted, the
    counts of the splits before it in its file are added up, and a line's number
    is that sum and its place in the split. Only counts per split are shuffled.
    """
    place = F.monotonically_increasing_id().alias("_at")
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), place, "value"
    )
    # Written, so that both uses see the same places.
    rows = settle(rows, "lines")
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    text = F.decode(F.col("value").cast("binary"), encoding)
    return lookup(rows, splits, ["_path", "_start"]).select(
        F.regexp_extract("_path", r"([^/]+)$", 1).alias("file"), (F.col("_before") + F.col("_at") - F.col("_first")).alias("line"),
        F.regexp_replace(text, "\r", "").alias("value"),
    )


def film_urls(spark: SparkSession, root: str, split: str) -> DataFrame:
    """``label, review_id, film_id``: line n of a URL file belongs to review n. A missing file contributes no rows."""
    out = spark.createDataFrame([], "label int, review_id int, film_id string")
    for name, label in CLASSES:
        try:
            lines = numbered_lines(spark, f"{root}/{split}/urls_{name}.txt").filter("value <> ''")
        except AnalysisException:
            continue
        out = out.unionByName(lines.select(
            F.lit(label).alias("label"), F.col("line").cast("int").alias("review_id"),
            F.nullif(F.regexp_extract("value", r"/title/(tt\d+)/", 1), F.lit("")).alias("film_id"),
        ))
    return out


def review_tree(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One file per review: ``<root>/<split>/<neg|pos>/<id>_<rating>.txt``."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {', '.join(SPLITS)}")
    rows = None
    for name, label in CLASSES:
        files = spark.read.text(f"{root}/{split}/{name}/*.txt", wholetext=True)
        path = F.col("_metadata.file_name")
        one = files.select(
            F.concat(F.lit(f"{split}/{name}/"), F.regexp_replace(path, r"\.txt$", "")).alias("doc_id"),
            F.col("value").alias("text"), F.lit(label).alias("label"),
            F.regexp_extract(path, r"_(\d+)\.txt$", 1).cast("int").alias("rating"),
            F.regexp_extract(path, r"^(\d+)_", 1).cast("int").alias("review_id"),
        )
        rows = one if rows is None else rows.unionByName(one)
    films = film_urls(spark, root, split)
    return lookup(rows, films, ["label", "review_id"], "left").select(
        "doc_id", "text", "label", "rating", "film_id"
    )


def polarity_folders(spark: SparkSession, root: str, seed=SEED) -> DataFrame:
    """One file per review in ``neg/`` and ``pos/``, with a seeded random ``order_key``."""
    files = spark.read.text([f"{root}/neg", f"{root}/pos"], wholetext=True)
    parts = F.regexp_extract("_metadata.file_path", r"(neg|pos)/([^/]+)$", 0)
    rows = files.select(
        parts.alias("doc_id"), F.col("value").alias("text"),
        F.startswith(parts, F.lit("pos")).cast("int").alias("label"),
    )
    return rows.withColumn("order_key", seeded_hash(seed, "doc_id"))


def polarity_lines(spark: SparkSession, paths: dict[str, int], seed=SEED) -> DataFrame:
    """One review per line of Latin-1 files; ``paths`` maps each file to its label.

    Blank lines are dropped but keep their number, counted from 0.
    """
    out = None
    for path, label in paths.items():
        lines = numbered_lines(spark, path, "ISO-8859-1")
        rows = lines.withColumn("text", F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))).filter("text <> ''")
        one = rows.select(F.concat_ws(":", "file", "line").alias("doc_id"), "text", F.lit(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("order_key", seeded_hash(seed, "doc_id"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet copy at ``path``; built and written when it is not there.

    A copy that is there but can't be read is an error, and is left alone.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


class Corpora:
    """Corpora by short name."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
        self._loaders[name] = loader

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(f"unknown corpus {name!r}; choose from {', '.join(sorted(self._loaders))}")
        return self._loaders[name](spark)


def film_corpora(root: str, cache: str | None = None) -> Corpora:
    """The film review corpora below ``root`` under their short names, by the layout each is published in.

    With ``cache``, a folder, a corpus is read from its Parquet copy once that
    is there.
    """
    lines = {f"{root}/rt_polarity/rt-polarity.{name}": label for name, label in CLASSES}
    known: dict[str, Callable[[SparkSession], DataFrame]] = {
        "pang_lee": lambda spark: polarity_folders(spark, f"{root}/pang_lee"),
        "rt_polarity": lambda spark: polarity_lines(spark, lines),
    }
    for split in SPLITS:
        known[f"imdb_{split}"] = partial(review_tree, root=f"{root}/imdb", split=split)
    corpora = Corpora()
    for name, load in known.items():
        corpora.register(name, load if cache is None else partial(_through_cache, path=f"{cache}/{name}", load=load))
    return corpora


def _through_cache(spark: SparkSession, path: str, load) -> DataFrame:
    return cached(spark, path, lambda: load(spark))


def review_list(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of a list of reviews to score.

    A ``.json`` file holds an array of texts, or an object with the array
    under ``reviews``; any other file holds one review per line.
    """
    if not path.endswith(".json"):
        lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
        return lines.filter("text <> ''")
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(
        F.from_json("value", "array<string>"), F.from_json("value", "reviews array<string>")["reviews"]
    )
    return whole.select(F.explode(listed).alias("text"))


def one_review(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")
