"""Scores of texts with more words than any fixed vocabulary held: every word counts."""

from collections import Counter

import numpy as np

from reviewlytics.llm import lm_scores


def test_rare_words_are_learnt(spark):
    # 20,000 words of equal frequency; before, 3,616 of them were one unknown word.
    words = [f"w{i}" for i in range(20_000)]
    texts = [words[i : i + 500] for i in range(0, 20_000, 500)] * 2
    target = {i for i in range(0, 80, 3)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = lm_scores.cross_entropy_difference(docs, spark.createDataFrame([(x,) for x in target], "doc_id long")).collect()
    want = {}
    models = []
    for part in (target, range(80)):
        one, two, before = Counter(), Counter(), Counter()
        for i in part:
            one.update(texts[i])
            two.update(zip([None, *texts[i]], texts[i], strict=False))
            before.update([None, *texts[i][:-1]])
        models.append((one, two, before, sum(one.values())))
    for i, t in enumerate(texts):
        want[i] = [
            np.mean([-np.log2((two[p, w] + 100 * (one[w] + 1) / (n + 20_002)) / (before[p] + 100)) for p, w in zip([None, *t], t, strict=False)])
            for one, two, before, n in models
        ]
    assert len(found) == 80
    assert all(np.allclose([r.target_loss, r.background_loss], want[r.doc_id], atol=1e-9) for r in found)


def test_counts_in_few_bytes():
    rng = np.random.default_rng(5)
    for values in (rng.exponential(2.0**41, 20_000).astype(np.uint64), rng.integers(1, 3, 20_000), np.array([], np.int64), np.array([0]), np.array([(1 << 64) - 1], np.uint64)):
        assert lm_scores._unpacked(lm_scores._packed(values), len(values)).tolist() == values.tolist()
    # Distances of random keys: of the top byte of each most is empty; before, all six bytes were written.
    assert len(lm_scores._packed(rng.exponential(2.0**41, 20_000).astype(np.uint64))) < 5.7 * 20_000
