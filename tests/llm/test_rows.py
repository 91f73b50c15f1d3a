"""Row keys: rows without an id are told apart by their texts alone."""

from collections import Counter

from pyspark.sql import functions as F

from reviewlytics.llm import exact_dedup, substring_dedup

# The low 32 bits of the hashes of these texts are equal.
ONE, TWO = "text 150395", "text 166689"
SCHEMA = "doc_id long, text string"


def test_texts_of_equal_short_hashes_stay_apart(spark):
    low = spark.createDataFrame([(ONE,), (TWO,)], "text string").select(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"))
    assert low.distinct().count() == 1
    found = exact_dedup.exact_groups(spark.createDataFrame([(None, ONE), (None, TWO), (7, ONE), (7, TWO)], SCHEMA)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == {(None, 7, 2, False): 2, (7, 7, 2, True): 2}
    found = substring_dedup.substring_dedup(spark.createDataFrame([(None, ONE), (None, TWO), (1, ONE)], SCHEMA), span=2).collect()
    assert Counter((r.doc_id, r.n_removed) for r in found) == {(None, 2): 1, (None, 0): 1, (1, 2): 1}


def test_substring_arrays_are_made_of_small_pieces():
    import pyarrow as pa

    from reviewlytics.llm import substring_dedup

    text = " ".join(f"w{i % 977}x{i % 89}" for i in range(100_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array([text] * 3)], ["doc", "tag", "text"])
    # Before, all three were one piece.
    assert len(list(substring_dedup._vertices(iter([batch]), 35))) == 3
