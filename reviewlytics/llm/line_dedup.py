"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.components import components
from reviewlytics.llm.rows import given_id, keyed
from reviewlytics.runtime import lookup, settle

#: A SimHash has BITS bits in BLOCKS blocks. Lines that differ in DIFFERENCES bits at most agree in the other blocks.
BITS, BLOCKS, DIFFERENCES = 60, 4, 2
EDIT_SIMILARITY = 0.9
#: A long counts FIELDS bits of the words' hashes, each in BITS // FIELDS bits: 1,023 different words fill none of six counts, a billion none of two.
FEW, MANY = 6, 2
#: A line of so many characters has 1,023 different words at most, the empty one between two blanks included.
FEW_CHARS = 2_044
#: Shared ends of two lines are found in steps of 2 ** 16 to 2 ** 5 characters; so many differences are looked for first.
END_STEPS, FIRST_DISTANCE = range(16, 4, -1), 16


def normalised_line(lines: DataFrame) -> DataFrame:
    """``line`` in lower case, everything but letters as one blank; a line without letters stays as it is.

    The letters are a column of their own: within one expression they would be worked out twice.
    """
    plain = F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}]+", " "))
    return lines.withColumn("__plain", plain).withColumn("line", F.when(F.col("__plain") == "", F.col("line")).otherwise(F.col("__plain"))).drop("__plain")


def _majorities(lines: DataFrame, fields: int) -> DataFrame:
    """``name``, the other columns and ``simhash`` of ``lines`` whose different words fill no count of BITS // ``fields`` bits."""
    kept = [c for c in lines.columns if c != "line"]
    width = BITS // fields
    ones = F.lit(sum(1 << width * i for i in range(fields))).cast("bigint")
    words = lines.select(*kept, F.explode(F.array_distinct(F.split("line", " "))).alias("word"))
    hashed = words.select(*kept, F.xxhash64("word").alias("h"))
    counts = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(ones)).alias(f"s{i}") for i in range(width)]
    sums = hashed.groupBy(*kept).agg(F.count(F.lit(1)).alias("n"), *counts)
    # A count of more than half the words reaches its field's top bit when so much is added to all.
    sums = sums.withColumn("lift", (F.lit((1 << width - 1) - 1) - F.shiftright("n", 1)) * ones)
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{i}") + F.col("lift"), width - 1).bitwiseAND(ones), i) for i in range(width)]
    return sums.select(*kept, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("simhash"))


def simhashes(lines: DataFrame) -> DataFrame:
    """``simhash`` of ``lines`` in place of ``line``: each bit is the majority of the distinct words' hashes. ``name`` is one line's alone.

    A line's words lie in one task, so its counts are summed there; the shuffle
    carries one row of packed counts per line. Lines of many words, which need
    wide counts, are summed apart.
    """
    few = F.length("line") <= FEW_CHARS
    return _majorities(lines.filter(few), FEW).union(_majorities(lines.filter(~few), MANY))


def _near(one: str, two: str):
    return F.bit_count(F.col(one).bitwiseXOR(F.col(two))) <= DIFFERENCES


def _without_ends(pairs: DataFrame) -> DataFrame:
    """``x`` and ``y`` without most of the start and the end that they share, both turned round; their edit distance stays the same."""
    steps = ", ".join(str(1 << k) for k in END_STEPS)
    for _ in range(2):
        pairs = pairs.withColumn("__at", F.expr(f"aggregate(array({steps}), 1, (at, n) -> if(substring(x, at, n) = substring(y, at, n), at + n, at))"))
        pairs = pairs.withColumns({c: F.reverse(F.expr(f"substring({c}, __at)")) for c in ("x", "y")}).drop("__at")
    return pairs


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lines are alike; only lines of candidates are moved."""
    pairs = settle(pairs.distinct(), "line-pairs")
    names = settle(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "paired-names")
    some = settle(lookup(lines.select("name", "line"), names, ["name"], "left_semi"), "paired-lines")
    texts = pairs.join(some.select(F.col("name").alias("a"), F.col("line").alias("x")), "a")
    texts = texts.join(some.select(F.col("name").alias("b"), F.col("line").alias("y")), "b")
    most = F.expr(f"cast(floor(greatest(length(x), length(y)) * {1 - similarity:.6f} + 1e-9) as int)")
    near = " or ".join(f"levenshtein(x, y, {t}) >= 0" for t in (f"least(most, {FIRST_DISTANCE})", "most"))
    # Written first: the optimizer would work the ends out anew in each place where the filter names them.
    ends = settle(_without_ends(texts.withColumn("most", most)), "paired-ends")
    return settle(ends.filter(F.expr(near)).select("a", "b"), "line-links")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = EDIT_SIMILARITY) -> DataFrame:
    """One row per line with a word: the group of alike lines it is in, and whether it is the one to keep.

    Columns: doc_id, tag (hash of the text), line_no (from 0), group_size,
    keep_doc_id, keep_line_no, kept. Lines are linked when their normalised
    forms are equal, or when their SimHashes (60 bits) differ in two bits at
    most and their edit similarity, 1 - distance / longer length, reaches
    ``similarity``. Of a connected group the line of least (doc_id, line_no)
    stays.

    Equal normalised lines are one node, however many there are. Lines in a
    block bucket are compared with its least one, and after that only across
    components. Lines of white space are no lines here. Null texts have none.
    A null id is less than all others and null in the result; rows that repeat
    id and text give equal rows, of which each is kept or none. Extra columns
    are not looked at. DataFrame functions only.
    """
    own = keyed(docs, id_col, text_col)
    lines = own.select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike("[^ \\t-\\r]"))
    lines = normalised_line(lines).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})
    # Normalised and written once; of equal lines one lends its name, and their texts never meet.
    lines = settle(lines.withColumn("name", F.monotonically_increasing_id()), "lines")
    hashes = simhashes(lines.select("name", "h1", "h2", "line"))
    hashes = settle(hashes.groupBy("h1", "h2").agg(F.min("name").alias("name"), F.min("simhash").alias("simhash")), "simhashes")

    size = BITS // BLOCKS
    block = [F.shiftrightunsigned("simhash", i * size).bitwiseAND(F.lit((1 << size) - 1)) for i in range(BLOCKS)]
    keys = []
    for t, some in enumerate(itertools.combinations(range(BLOCKS), BLOCKS - DIFFERENCES)):
        key = F.lit(t).cast("bigint")
        for i in some:
            key = F.shiftleft(key, size).bitwiseOR(block[i])
        keys.append(key)
    entries = hashes.select("name", "simhash", F.explode(F.array(*keys)).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("name").alias("lead")).filter("m > 1").drop("m")
    entries = settle(entries.join(shared, "bucket"), "line-buckets")
    leads = entries.filter("name = lead").select("bucket", F.col("simhash").alias("lead_hash"))
    pairs = entries.filter("name != lead").join(leads, "bucket").filter(_near("simhash", "lead_hash"))
    links = _verified(pairs.select(F.col("lead").alias("a"), F.col("name").alias("b")), lines, similarity)

    comps = components(links, "a", "b", native=True).withColumnRenamed("node", "name")
    rest = entries.filter("name != lead").join(comps, "name", "left").select("bucket", "name", "simhash", F.coalesce("comp", "name").alias("comp"))
    rest = settle(rest, "line-buckets")
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    rest = rest.join(mixed, "bucket", "left_semi")
    other = rest.select("bucket", *[F.col(c).alias(f"{c}_2") for c in ("name", "simhash", "comp")])
    across = rest.join(other, "bucket").filter((F.col("comp") < F.col("comp_2")) & _near("simhash", "simhash_2"))
    links = links.union(_verified(across.select(F.col("name").alias("a"), F.col("name_2").alias("b")), lines, similarity))

    comps = components(links, "a", "b", native=True).withColumnRenamed("node", "name")
    names = hashes.select("h1", "h2", "name").join(comps, "name", "left").select("h1", "h2", F.coalesce("comp", "name").alias("group"))
    found = settle(lines.select("doc", "tag", "line_no", "h1", "h2").join(names, ["h1", "h2"]).drop("h1", "h2"), "grouped-lines")
    groups = found.groupBy("group").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct("doc", "line_no")).alias("keep"))
    return found.join(groups, "group").select(
        given_id().alias("doc_id"), "tag", "line_no", "group_size", given_id("keep.doc").alias("keep_doc_id"),
        F.col("keep.line_no").alias("keep_line_no"), (F.struct("doc", "line_no") == F.col("keep")).alias("kept"),
    )
