"""Quality rules whose verdict is given per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.rows import given_id, keyed
from reviewlytics.runtime import settle

#: A host is refused when it is expected to break one of the rules in more than this share of its texts.
MOST_FAILURES = 0.5
#: At most so many hosts hold this fraction of all rows each; their verdicts are broadcast.
HOT = 1024
RULES = ("fails_base", "fails_symbols", "fails_lines")
_SPACES = "\t\n\x0b\x0c\r"


def _neighbours(array: str, how) -> Column:
    """``how`` of each two neighbours of an array column."""
    pairs = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), pairs), F.slice(array, F.lit(2), pairs), how)


def text_measures(own: DataFrame) -> DataFrame:
    """``own`` with counts in place of its column ``text``. All counting is done in the row.

    For repeated words, the three-word windows of a text are sorted with their
    positions: a window that equals a neighbour stands twice or more. Each such
    position covers the words up to the next one, three at most.
    """
    rest = [c for c in own.columns if c != "text"]
    n = F.size("__words")
    windows = F.greatest(n - 2, F.lit(0))
    by_parts = own.select(
        *rest,
        F.array_remove(F.split(F.translate("text", _SPACES, " " * len(_SPACES)), " "), "").alias("__words"),
        F.length(F.translate("text", " " + _SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("__lines"),
    )
    counted = by_parts.select(
        *rest, n.cast("bigint").alias("n_words"), "word_chars", "n_symbols", F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(F.arrays_zip(
            F.slice("__words", F.lit(1), windows).alias("a"), F.slice("__words", F.lit(2), windows).alias("b"),
            F.slice("__words", F.lit(3), windows).alias("c"),
            F.when(windows > 0, F.sequence(F.lit(1), windows)).otherwise(F.array().cast("array<int>")).alias("at"),
        )).alias("__sorted"),
    )
    twice = _neighbours("__sorted", lambda x, y: F.when(
        (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["at"], y["at"]),
    ))
    twice = counted.withColumn("__twice", F.sort_array(F.array_distinct(F.flatten(F.array_compact(twice))))).drop("__sorted")
    gaps = F.aggregate(_neighbours("__twice", lambda x, y: F.least(y - x, F.lit(3))), F.lit(0), lambda total, x: total + x)
    return twice.withColumn(
        "n_repeat_words", F.when(F.size("__twice") > 0, gaps + 3).otherwise(0).cast("bigint"),
    ).drop("__twice")


def broken_rules(measures: DataFrame) -> DataFrame:
    """One 0/1 column per rule: short or repetitive; symbols beyond a tenth of the words; lines mostly repeats."""
    return measures.withColumns({
        "fails_base": ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).cast("int"),
        "fails_symbols": (10 * F.col("n_symbols") > F.col("n_words")).cast("int"),
        "fails_lines": (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).cast("int"),
    })


def host_verdicts(broken: DataFrame) -> DataFrame:
    """Per ``host``: n, ``share_<rule>`` (posterior mean of its failures) and refused.

    The beta prior of a rule has the mean and variance of the hosts' own rates
    (method of moments), so a host of few texts moves to the mean of all. Where
    the rates don't vary, or vary more than any beta could, it weighs one text.
    """
    hosts = settle(broken.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(r) for r in RULES]), "hosts")
    rates = [(F.col(r) / F.col("n")) for r in RULES]
    seen = hosts.agg(
        F.sum("n").alias("all"), *[F.avg(x).alias(f"mean_{r}") for r, x in zip(RULES, rates, strict=True)],
        *[F.var_pop(x).alias(f"var_{r}") for r, x in zip(RULES, rates, strict=True)],
    ).first()
    shares = {}
    for r in RULES:
        mean, var = seen[f"mean_{r}"] or 0.0, seen[f"var_{r}"] or 0.0
        weight = mean * (1 - mean) / var - 1 if var > 0 else 1.0
        weight = weight if weight > 0 else 1.0
        shares[f"share_{r}"] = (F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    worst = F.greatest(*[F.col(x) for x in shares])
    return hosts.withColumns(shares).withColumns({"refused": worst > MOST_FAILURES, "hot": F.col("n") * HOT >= (seen["all"] or 0)})


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs`` with its measures and the verdict of its own rules and its host's.

    Columns: doc_id, tag (hash of the text), n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words, base_failed, host_refused, kept. A
    text that breaks the base rule goes; of the others, those of a refused host.

    Null, empty and blank texts have no words and break the base rule. Rows
    without a host form one host. Rows that repeat id and text count as often
    as they stand there and get equal verdicts. Extra columns are not looked
    at. A text is handled in its row, so it costs memory in proportion to its
    words. DataFrame functions only.
    """
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    broken = settle(broken_rules(text_measures(keyed(docs, id_col, text_col, host.alias("host")))), "measures")
    hosts = host_verdicts(broken).select("host", "refused", "hot")
    hot, rest = (F.broadcast(hosts.filter("hot").drop("hot")), hosts.filter("not hot").drop("hot"))
    joined = broken.join(hot, "host").unionByName(broken.join(hot, "host", "left_anti").join(rest, "host"))
    failed = F.col("fails_base") == 1
    return joined.select(
        given_id().alias("doc_id"), "tag", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("refused").alias("host_refused"), (~failed & ~F.col("refused")).alias("kept"),
    )
