import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlytics.functions.stats import binomial_quantiles, mcnemar_p
from reviewlytics.operators import evaluate, features, isotonic, linear, models, naive_bayes, reports, sampling, verdict
from reviewlytics.operators.normalise import RAW, normalise
from reviewlytics.operators.ranking import rank_by_hash, rank_by_range
from reviewlytics.plans.base import curve_draws
from reviewlytics.runtime import lookup, settle

TOY = [
    ("a wonderful moving film", 1), ("truly wonderful acting here", 1), ("a great and moving story", 1),
    ("great acting great fun", 1), ("superb story wonderful cast", 1), ("moving and superb film", 1),
    ("a dull boring film", 0), ("truly awful acting here", 0), ("a boring and dull story", 0),
    ("awful plot awful script", 0), ("terrible story boring cast", 0), ("dull and terrible film", 0),
]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(TOY)]
    return settle(normalise(spark.createDataFrame(rows, "doc_id int, text string, label int"), RAW))


def scores_table(spark, rng, n, digits=2):
    rows = [("ab"[i % 2], i, rng.randrange(2), round(rng.random(), digits)) for i in range(n)]
    df = spark.createDataFrame(rows, "model string, doc_id int, label int, score double")
    return rows, linear.with_prediction(df)


@pytest.mark.parametrize("name", sorted(models.BUILDERS))
def test_models_separate_the_toy_corpus(spark, toy, name):
    model = models.build_model(name, toy)
    rows = models.predict(toy, model, ["label"]).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.pred == r.label for r in rows) / 12 > 0.9
    top = {(r.side, r.term) for r in linear.top_terms(model, 4).collect()}
    assert ("positive", "wonderful") in top and ("negative", "dull") in top


def test_unknown_names(spark, toy):
    with pytest.raises(KeyError):
        models.build_model("oracle", toy)
    with pytest.raises(ValueError):
        verdict.film_verdicts(toy, "vibes")


def test_ratio_signs_and_effective_weights(spark, toy):
    keyed = toy.withColumn("fit", F.lit("all"))
    terms = features.term_rows(keyed, ["fit", "doc_id", "label"])
    vocab = features.with_idf(features.vocabulary(terms, ["fit"], features.NBSVM), None, ["fit"], features.NBSVM)
    weighted = features.tfidf(terms, vocab, ["fit"], features.NBSVM)
    r = {x.term: x.r for x in features.log_count_ratio(features.class_sums(weighted, ["fit"]), ["fit"]).collect()}
    assert r["wonderful"] > 0 > r["dull"]
    sides = {(x.term, x.side) for x in linear.explain(keyed, models.build_model("nbsvm", toy)).collect()}
    assert ("dull", "negative") in sides and ("dull", "positive") not in sides


def test_unknown_terms_fall_back_to_the_prior(spark, toy):
    model = models.build_model("naive_bayes", toy)
    odd = spark.createDataFrame([(1, ["zzz"]), (2, [])], "doc_id int, tokens array<string>")
    assert [r.score for r in models.predict(odd, model, []).collect()] == [0.5, 0.5]


def test_saved_model_scores_alike(spark, toy, tmp_path):
    model = models.build_model("nbsvm", toy)
    model.save(str(tmp_path / "m"))
    again = linear.LinearModel.load(spark, str(tmp_path / "m"))
    a = {r.doc_id: r.score for r in models.predict(toy, model, []).collect()}
    assert a == {r.doc_id: r.score for r in models.predict(toy, again, []).collect()}


def test_grid_search_and_nested(spark, toy):
    folded = toy.withColumn("fold", F.col("doc_id") % 3).withColumn("stratum_rank", F.col("doc_id") + 1)
    tuned = models.tune("naive_bayes", folded, 3, (0.1, 1.0))
    assert tuned.meta["parameter"] in (0.1, 1.0) and 0 <= tuned.meta["cv_accuracy"] <= 1


def test_capped_vocabulary_is_exact_with_ties(spark):
    rng = random.Random(5)
    counts = {f"t{i:03d}": rng.randrange(2, 6) for i in range(200)}
    rows = [("x", t, n, n) for t, n in counts.items()]
    df = settle(spark.createDataFrame(rows, "fit string, term string, df int, cf int"))
    want = {t for t, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:70]}
    got = features.most_frequent(df, ["fit"], "cf", 70).collect()
    assert {r.term for r in got} == want and len(got) == 70


def test_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    import reviewlytics.runtime as runtime
    left = spark.range(100).select((F.col("id") % 7).alias("k"))
    small = settle(spark.range(5).select(F.col("id").alias("k"), F.lit("v").alias("v")))
    near = lookup(left, small, ["k"]).count()
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    shuffled = lookup(left, small, ["k"])
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().toString() and shuffled.count() == near


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 10 < 9).cast("int").alias("label"))
    a = rank_by_hash(df.repartition(1), ["label"], "doc_id", 1).collect()
    b = rank_by_hash(df.repartition(8), ["label"], "doc_id", 1).collect()
    assert sorted(a) == sorted(b)
    assert sorted(r["rank"] for r in a if r.label == 1) == list(range(1, 451))
    by_range = rank_by_range(df, ["label"], [F.desc("doc_id")]).filter("label = 1").orderBy("rank").collect()
    ids = [r.doc_id for r in by_range]
    assert ids == sorted(ids, reverse=True) and [r["rank"] for r in by_range] == list(range(1, 451))


def test_splits_keep_class_shares(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") < 20).cast("int").alias("label"))
    parts = sampling.stratified_split(df).groupBy("label", "part").count().collect()
    assert {(r.label, r.part): r["count"] for r in parts} == {
        (0, "test"): 16, (0, "train"): 64, (1, "test"): 4, (1, "train"): 16}
    drawn = sampling.stratified_subsamples(df, {10: 5, 100: 5}, 100).groupBy("train_size", "draw").count().collect()
    assert {(r.train_size, r.draw): r["count"] for r in drawn} == {**{(10, d): 10 for d in range(5)}, (100, 0): 100}
    assert curve_draws(5_000) == {200: 5, 500: 5, 1_000: 5, 2_500: 5, 5_000: 1} and curve_draws(60) == {60: 1}


def test_auc_and_average_precision_against_brute_force(spark):
    rows, scored = scores_table(spark, random.Random(1), 400)
    auc = {r.model: r.roc_auc for r in evaluate.roc_auc(scored, ["model"]).collect()}
    ap = {r.model: r.average_precision for r in evaluate.average_precision(scored, ["model"]).collect()}
    for m in "ab":
        pos = [r[3] for r in rows if r[0] == m and r[2] == 1]
        neg = [r[3] for r in rows if r[0] == m and r[2] == 0]
        want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
        assert auc[m] == pytest.approx(want)
        total, last = 0.0, 0.0
        for t in sorted(set(pos + neg), reverse=True):
            hit, taken = sum(p >= t for p in pos), sum(s >= t for s in pos + neg)
            total, last = total + (hit / len(pos) - last) * hit / taken, hit / len(pos)
        assert ap[m] == pytest.approx(total)


def test_calibration_error_against_brute_force(spark):
    rows, scored = scores_table(spark, random.Random(2), 600)
    got = {r.model: r.ece for r in evaluate.expected_calibration_error(scored, ["model"]).collect()}
    edges = np.linspace(0.5, 1.0, 11)
    for m in "ab":
        s = np.array([r[3] for r in rows if r[0] == m])
        y = np.array([r[2] for r in rows if r[0] == m])
        c, ok = np.where(s >= 0.5, s, 1 - s), (s >= 0.5).astype(int) == y
        want = 0.0
        for lo, hi in zip(edges[:-1], edges[1:]):
            sel = (c > lo) & (c <= hi)
            if sel.any():
                want += sel.sum() / len(s) * abs(ok[sel].mean() - c[sel].mean())
        assert got[m] == pytest.approx(want)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.4), ("a", 2, 1, 0.9)], "model string, doc_id int, label int, score double")
    rec = evaluate.compute_metrics(linear.with_prediction(df), ["model"]).first()
    assert rec.roc_auc is None and rec.accuracy == 0.5 and rec.f1_negative == 0.0


def test_mcnemar_golden_values():
    assert mcnemar_p(737, 718) == pytest.approx(0.6370, abs=5e-5)
    assert mcnemar_p(683, 680) == pytest.approx(0.9568, abs=5e-5)
    assert mcnemar_p(0, 0) == 1.0 and mcnemar_p(30, 0) < 1e-6 and mcnemar_p(3, 9) == mcnemar_p(9, 3)


def test_binomial_interval_is_the_bootstrap_limit():
    draws = np.random.default_rng(0).binomial(40, 0.7, 200_000) / 40
    low, high = binomial_quantiles(40, 28)
    assert (low, high) == (pytest.approx(np.percentile(draws, 2.5)), pytest.approx(np.percentile(draws, 97.5)))


def films(spark, groups):
    rows = [(name, f"{name}{i}", float(s), int(s >= 0.5)) for name, ss in groups.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "film_id string, doc_id string, score double, label int")


def test_trimmed_mean_against_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {f"f{i}": np.round(rng.random(rng.integers(1, 40)), 2) for i in range(120)}
    got = {r.film_id: r for r in verdict.rule_scores(films(spark, groups), ["film_id"]).collect()}
    for name, s in groups.items():
        want = s.mean()
        if len(s) >= 5:
            lo, hi = np.quantile(s, [0.1, 0.9])
            kept = s[(s >= lo - 1e-12) & (s <= hi + 1e-12)]
            want = kept.mean()
        assert got[name].trimmed_mean == pytest.approx(want), (name, s)
        assert got[name].majority == pytest.approx((s >= 0.5).mean())


def test_verdicts(spark):
    df = films(spark, {
        "clear": [0.95] * 20, "split": [0.05, 0.95] * 10, "single": [0.8], "troll": [0.85] * 18 + [0.001] * 2,
        "three": [0.99, 0.99, 0.01], "flat": [0.7] * 8,
    })
    v = {r.film_id: r for r in verdict.film_verdicts(df).collect()}
    assert v["clear"].decisive and v["clear"].sentiment == "positive" and v["clear"].share_positive == 1.0
    assert not v["split"].decisive and v["split"].polarisation > 0.4
    assert v["three"].score == pytest.approx(2 / 3) and v["flat"].polarisation == pytest.approx(0)
    every = {(r.film_id, r.method): r for r in verdict.compare_rules(df, n_boot=200).collect()}
    assert len(every) == 18
    one = every["single", "mean_probability"]
    assert one.ci_low == one.ci_high == pytest.approx(0.8)
    assert every["troll", "trimmed_mean"].score > every["troll", "mean_probability"].score
    for r in every.values():
        assert r.ci_low - 1e-9 <= r.score <= r.ci_high + 1e-9
    again = {(r.film_id, r.method): r for r in verdict.compare_rules(df.repartition(7), n_boot=200).collect()}
    assert {k: (r.ci_low, r.ci_high) for k, r in every.items()} == {k: (r.ci_low, r.ci_high) for k, r in again.items()}
    lines = {r.film_id: r.summary for r in verdict.summary_line(verdict.film_verdicts(df)).collect()}
    assert "NEGATIVE" not in lines["clear"] and "not statistically decisive" in lines["split"]


def test_large_films_have_the_interval_of_small_ones(spark):
    rng = np.random.default_rng(8)
    df = films(spark, {"even": rng.random(150), "high": rng.beta(5, 2, 400), "ties": rng.choice([0.2, 0.5, 0.9], 300)})
    rows, cells = (
        {r.film_id: r for r in verdict.bootstrap_intervals(df, n_boot=2_000, in_row=n).collect()} for n in (1_000, 0)
    )
    for name, one in rows.items():
        for rule in verdict.RULES:
            for end in ("low", "high"):
                a, b = one[f"{rule}_{end}"], cells[name][f"{rule}_{end}"]
                width = one[f"{rule}_high"] - one[f"{rule}_low"]
                assert abs(a - b) <= 0.15 * width + (0.02 if name == "ties" else 0.002), (name, rule, end)
    again = {r.film_id: r for r in verdict.bootstrap_intervals(df.repartition(5), n_boot=2_000, in_row=0).collect()}
    assert {k: tuple(round(x, 9) for x in v[1:]) for k, v in cells.items()} == {k: tuple(round(x, 9) for x in v[1:]) for k, v in again.items()}


def _plain_draws(rows, n_boot, seed):
    """Every draw of one film, review by review: the three rules."""
    import hashlib

    ordered = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[1]}".encode()).hexdigest(), r[1]))
    n, out = len(rows), []
    for draw in range(1, n_boot + 1):
        picks = [int(hashlib.md5(f"{seed}:{film}:{draw}:{doc}".encode()).hexdigest()[:8], 16) % n for film, doc, _ in ordered]
        drawn = np.sort([round(ordered[k][2], 9) for k in picks])
        low, high = drawn[-(-(n - 1) * 10 // 100)], drawn[(n - 1) * 90 // 100]
        out.append(((drawn >= 0.5).mean(), drawn.mean(), drawn[(drawn >= low) & (drawn <= high)].mean()))
    return np.quantile(out, (0.025, 0.975), axis=0)


def test_films_of_any_size_are_drawn_review_by_review(spark, monkeypatch):
    rng = np.random.default_rng(5)
    scores = {"large": rng.beta(5, 2, 2_300), "ties": rng.choice([0.2, 0.5, 0.9], 2_100), "small": rng.random(40)}
    rows = [(film, f"{film}-{i}", float(x)) for film, some in scores.items() for i, x in enumerate(some)]
    df = spark.createDataFrame(rows, "film_id string, doc_id string, score double")
    found = {"whole": verdict.bootstrap_intervals(df, n_boot=60).collect(), "parts": verdict.bootstrap_intervals(df, n_boot=60, in_row=50).collect()}
    for name, value in (("SLICE", 500), ("CHUNK", 700), ("PICKS", 20_000)):
        monkeypatch.setattr(verdict, name, value)
    found["many parts"] = verdict.bootstrap_intervals(df, n_boot=60).collect()
    # Few draws are in windows as narrow as this, so all scores are passed on.
    monkeypatch.setattr(verdict, "WIDTH", -0.2)
    found["missed"] = verdict.bootstrap_intervals(df, n_boot=60).collect()
    for film in scores:
        want = _plain_draws([r for r in rows if r[0] == film], 60, verdict.SEED)
        for way, got in found.items():
            row = next(r for r in got if r.film_id == film)
            for k, rule in enumerate(verdict.RULES):
                assert (row[f"{rule}_low"], row[f"{rule}_high"]) == pytest.approx(tuple(want[:, k]), abs=1e-9), (film, way, rule)


def test_reviews_of_equal_keys_pick_alike(spark):
    df = spark.createDataFrame([("f", None if i % 2 else "d", i / 30) for i in range(30)], "film_id string, doc_id string, score double")
    whole, parts = (verdict.bootstrap_intervals(df, n_boot=40, in_row=n).first() for n in (None, 0))
    assert all(0 <= x <= 1 for x in whole[1:]) and all(0 <= x <= 1 for x in parts[1:])


def test_length_bins_keep_ties_together(spark):
    words = [1] * 30 + [2] * 30 + [3, 4, 5, 6, 7, 8, 9, 10] * 5
    df = spark.createDataFrame([(i, w, 1, 1) for i, w in enumerate(words)], "doc_id int, words int, label int, pred int")
    rows = {r.length_bin: (r.min_words, r.max_words, r.n) for r in reports.by_length(df).collect()}
    edges = np.quantile(words, [0.2, 0.4, 0.6, 0.8])
    bins = [int(np.searchsorted(edges, w, side="left")) for w in words]
    want = {f"Q{b + 1}": bins.count(b) for b in set(bins)}
    assert {k: v[2] for k, v in rows.items()} == want


def _isotonic(scores, labels):
    """Largest least mean over the stretches around each distinct score."""
    xs = sorted(set(scores))
    y = [sum(b for a, b in zip(scores, labels) if a == x) for x in xs]
    n = [scores.count(x) for x in xs]
    mean = lambda i, j: sum(y[i : j + 1]) / sum(n[i : j + 1])
    return xs, [max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]


@pytest.mark.parametrize("digits", [1, 2, 5])
def test_isotonic_against_a_plain_version(spark, digits):
    rng = random.Random(digits)
    scores = [round(rng.random(), digits) for _ in range(120)] + [0.0, 1.0]
    labels = [int(rng.random() < s) for s in scores]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int")
    fitted = isotonic.fit_isotonic(df)
    xs, ys = _isotonic(scores, labels)
    odd = spark.createDataFrame([(x,) for x in [-0.0, 0.0003, 0.05, 0.33333, 0.5, 0.77, 0.99991, 1.0, *scores]], "score double")
    for found in (fitted.transform(odd), fitted.merged(odd)):
        assert all(r.calibrated == pytest.approx(float(np.interp(r.score, xs, ys))) for r in found.collect())
    assert found.count() == len(scores) + 8


def test_isotonic_of_nothing(spark):
    none = spark.createDataFrame([], "score double, label int")
    assert isotonic.fit_isotonic(none).transform(spark.createDataFrame([(0.5,)], "score double")).first().calibrated is None


def test_bayes_weights_by_hand(spark):
    docs = spark.createDataFrame([("m", 1, 1, ["a", "b"]), ("m", 2, 0, ["a", "c"]), ("m", 3, 1, ["b", "c"])],
                                 "fit string, doc_id int, label int, tokens array<string>")
    options = features.VectorOptions(ngram_max=1, min_df=1, use_idf=False, normalise=False)
    model = naive_bayes.fit(docs, ["fit"], (1.0,), options)
    w = {r.term: r.weight for r in model.weights.collect()}
    assert w["b"] == pytest.approx(math.log(3 / 7) - math.log(1 / 5))
    assert model.bias.first().bias == pytest.approx(math.log(2))
