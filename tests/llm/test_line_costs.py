"""Line dedup: what its shortcuts must keep, and work that must be done once."""

import random

from pyspark.sql import functions as F

from reviewlytics.llm import line_dedup


def test_simhash_is_the_majority_for_lines_of_any_length(spark):
    pick = random.Random(5)
    lines = [" ".join(f"w{pick.randrange(9 * n)}" for _ in range(n)) for n in (1, 2, 3, 40, 511, 700, 3000)] + ["?  ! ?", " ".join(map(chr, range(0x4E00, 0x4E00 + 1022)))]
    given = spark.createDataFrame(list(enumerate(lines)), "name long, line string")
    hashes = dict(given.select(F.explode(F.split("line", " ")).alias("w")).distinct().select("w", F.xxhash64("w")).collect())
    for name, found in line_dedup.simhashes(given).select("name", "simhash").collect():
        own = [hashes[w] for w in set(lines[name].split(" "))]
        assert found == sum(1 << i for i in range(line_dedup.BITS) if 2 * sum(h >> i & 1 for h in own) > len(own))


def test_shared_ends_do_not_change_the_distance(spark):
    pick = random.Random(6)
    pairs = []
    for n in (0, 1, 31, 32, 33, 200, 900):
        x = "".join(pick.choice("aé语 ") for _ in range(n))
        for edits in (1, 2, 30):
            y = list(x)
            for _ in range(edits):
                at = pick.randrange(len(y) + 1)
                y[at : at + pick.randrange(2)] = pick.choice(("", "b", "bc"))
            pairs.append((x, "".join(y)))
    pairs += [("a" * 100, "a" * 64), ("ab" * 40, "ab" * 40 + "語")]
    whole = spark.createDataFrame(pairs, "x string, y string").withColumns({"a": F.col("x"), "b": F.col("y")})
    cut = line_dedup._without_ends(whole)
    assert cut.filter("levenshtein(x, y) <> levenshtein(a, b)").isEmpty()
    assert cut.filter("length(a) = 900 and length(x) > 800").count() <= 2


def test_lines_are_normalised_once_and_only_candidates_move(spark, monkeypatch):
    """Fails where texts are read and normalised again for the last join."""
    plans = []
    kept = line_dedup.settle
    monkeypatch.setattr(line_dedup, "settle", lambda df, name="t": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(60))
    docs = spark.createDataFrame([(1, long + "\nalone"), (2, long.replace("wordaa", "wordab", 1)), (3, None)], "doc_id long, text string")
    found = line_dedup.line_groups(docs)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert sum("regexp_replace" in p for p in plans) == 1
    assert found.count() == 3
