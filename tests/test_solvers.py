"""The solver against a plain Newton method in NumPy, and its certificate."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlytics.operators import features, models
from reviewlytics.operators.solvers import Fit, SharedVectors
from reviewlytics.plans.base import turns
from reviewlytics.runtime import settle

WORDS = [f"w{i}" for i in range(40)]


def _docs(n, seed):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        label = pick.randrange(2)
        pool = WORDS[: 30 if label else 40][0 if label else 10 :]
        rows.append((i, label, [pick.choice(pool) for _ in range(pick.randrange(0, 14))], i % 3, i + 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return settle(spark.createDataFrame(_docs(150, 4), "doc_id int, label int, tokens array<string>, fold int, stratum_rank int"))


def _plain(rows, options, cost, kind, ratio):
    """Vectors by hand, then Newton with a full Hessian and step halving."""
    grams = [t + [" ".join(p) for p in zip(t, t[1:], strict=False)] for _, _, t, *_ in rows]
    df = {}
    for g in grams:
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    vocabulary = sorted(t for t, n in df.items() if n >= 2)
    at = {t: i for i, t in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, g in enumerate(grams):
        for t in set(g) & at.keys():
            tf = g.count(t)
            weight = 1.0 if options.binary else 1 + np.log(tf)
            x[i, at[t]] = weight * (np.log((1 + len(rows)) / (1 + df[t])) + 1 if options.use_idf else 1.0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    y = np.array([r[1] for r in rows]) * 2.0 - 1
    r = np.ones(len(vocabulary))
    if ratio:
        p, q = x[y > 0].sum(axis=0) + 1, x[y < 0].sum(axis=0) + 1
        r = np.log((p / p.sum()) / (q / q.sum()))
    x = np.column_stack((x * r, np.ones(len(rows))))

    def parts(w):
        z = y * (x @ w)
        if kind == "logistic":
            s = 1 / (1 + np.exp(z))
            return np.logaddexp(0, -z).sum(), -y * s, s * (1 - s)
        gap = np.maximum(0, 1 - z)
        return (gap**2).sum(), -2 * y * gap, 2.0 * (gap > 0)

    w = np.zeros(x.shape[1])
    value = lambda w: 0.5 * w @ w + cost * parts(w)[0]
    for _ in range(100):
        _, one, two = parts(w)
        g = w + cost * x.T @ one
        step = -np.linalg.solve(np.eye(len(w)) + cost * (x.T * two) @ x, g)
        while value(w + step) > value(w) and np.linalg.norm(step) > 1e-14:
            step /= 2
        w = w + step
    return {t: (w[i] * r[i]) for t, i in at.items()}, w[-1], value(w)


@pytest.mark.parametrize(("name", "cost"), [("linear_svm", 0.5), ("logistic_regression", 16.0), ("nbsvm", 100.0)])
def test_solver_equals_a_plain_newton_fit(spark, docs, name, cost):
    model = models.train(name, docs, cost, tolerance=1e-10)
    weights, bias, loss = _plain(_docs(150, 4), models.options_of(name), cost, models.LOSSES[name], name == "nbsvm")
    found = {r.term: r.weight for r in model.weights.collect()}
    assert found.keys() == weights.keys()
    assert max(abs(found[t] - weights[t]) for t in found) < 1e-6
    assert model.bias.first().bias == pytest.approx(bias, abs=1e-6)
    assert model.meta["loss"] == pytest.approx(loss) and model.meta["converged"]


@pytest.mark.parametrize("name", ["linear_svm", "logistic_regression", "nbsvm"])
def test_certificate(spark, docs, name):
    model = models.train(name, docs, 4.0)
    row = models.stationarity(docs, model, models.LOSSES[name], 4.0).first()
    assert (row.n_docs, row.n_terms) == (150, model.weights.count())
    assert row.gradient_at_zero == pytest.approx(model.meta["gradient_at_zero"])
    assert row.gradient <= 2e-7 * row.gradient_at_zero
    off = models.LinearModel(model.weights.withColumn("weight", F.col("weight") * 1.001), model.bias, ["fit"], model.options)
    assert models.stationarity(docs, off, models.LOSSES[name], 4.0).first().gradient > 1e-5 * row.gradient_at_zero


@pytest.mark.parametrize("name", ["naive_bayes", "nbsvm"])
def test_folds_together_equal_folds_alone(spark, docs, name):
    grid = (0.5, 2.0)
    runs = models.cross_validate(name, docs, 3, grid, 1e-5)
    assert len(runs) == 6 and runs["converged"].all()
    for run in runs.to_dict("records"):
        extra = {} if name == "naive_bayes" else {"tolerance": 1e-5}
        alone = models.build_model(name, docs.filter(F.col("fold") != run["fold"]), run["parameter"], **extra)
        scored = models.predict(docs.filter(F.col("fold") == run["fold"]), alone, ["label"])
        assert run["accuracy"] == pytest.approx(scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0])


def test_nested_validation(spark, docs):
    runs = models.nested_accuracy("logistic_regression", docs, 2, 2, (0.1, 4.0), 1e-5)
    assert runs["fold"].to_list() == [0, 1] and runs["converged"].all()
    rank = F.col("stratum_rank") - 1
    for run in runs.to_dict("records"):
        rest = docs.filter(rank % 2 != run["fold"]).withColumn("fold", (F.floor(rank / 2) % 2).cast("int"))
        alone = models.tune("logistic_regression", rest, 2, (0.1, 4.0), 1e-5)
        scored = models.predict(docs.filter(rank % 2 == run["fold"]), alone, ["label"])
        assert alone.meta["parameter"] == run["parameter"]
        assert run["accuracy"] == pytest.approx(scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0])


def test_groups_of_fits_and_parts(spark, docs, monkeypatch):
    monkeypatch.setattr("reviewlytics.operators.solvers.PASS_BYTES", 1)
    placed = docs.withColumns({"held": F.array(F.lit(0)), "slice": F.col("fold")})
    vectors = SharedVectors(placed, features.TFIDF, 1, 3)
    fits = vectors.minimise("logistic", [Fit(0, 1.0), Fit(0, 8.0)])
    right, n = vectors.hits(fits)
    assert n.sum(axis=0).tolist() == [150, 150] and n[:, 0].tolist() == [50, 50, 50] and (right <= n).all()
    vectors.close()


def test_capped_vocabulary_of_each_set(spark, docs):
    options = features.VectorOptions(max_features=12)
    vectors = SharedVectors(docs.withColumns(models.leave_out("fold", 3)), options, 3)
    assert [f.n_features for f in vectors.naive_bayes((1.0,))] == [12, 12, 12]
    vectors.close()


def test_sums_in_slices_and_few_partitions(spark, docs, monkeypatch):
    placed = docs.repartition(30).withColumns(models.leave_out("fold", 3))
    plain = SharedVectors(placed, features.TFIDF, 3)
    expected = plain.accuracies(plain.naive_bayes((0.5, 1.0)))
    # What the driver gets goes by the cores, however many partitions the documents have.
    assert plain.blocks.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    plain.close()
    monkeypatch.setattr("reviewlytics.operators.solvers.SLICE_BYTES", 64)
    monkeypatch.setattr("reviewlytics.operators.solvers.RELEASE_BYTES", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    sliced = SharedVectors(placed, features.TFIDF, 3)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert sliced.accuracies(sliced.naive_bayes((0.5, 1.0))) == pytest.approx(expected)
    sliced.close()


def test_sets_in_turns(spark, docs):
    placed = docs.withColumns(models.leave_out("fold", 3))
    together = SharedVectors(placed, features.TFIDF, 3)
    expected = together.accuracies(together.naive_bayes((1.0,)))
    together.close()
    found = []
    for first, n in ((0, 2), (2, 1)):
        vectors = SharedVectors(models.some_sets(placed, first, n), features.TFIDF, n)
        fits = vectors.naive_bayes((1.0,))
        assert [f.train for f in fits] == list(range(n)) and len(vectors.n_docs) == n
        found += list(vectors.accuracies(fits))
        vectors.close()
    assert found == pytest.approx(list(expected))
    # Small draws of a size go together, larger ones take turns.
    assert turns([(200, 4)] * 5 + [(1_000, 6)] * 5 + [(2_500, 6)] * 2 + [(5_000, 1)] * 3) == [
        [0, 1, 2, 3, 4], [5, 6, 7], [8, 9], [10], [11], [12, 13, 14],
    ]


def test_sets_without_documents_and_repeated_numbers(spark):
    rows = [(0, 1, ["a", "b"], [0, 0]), (1, 0, ["a", "c"], [0]), (2, 1, ["b", "c"], None), (3, 0, [], [0]), (4, 1, None, [0])]
    vectors = SharedVectors(spark.createDataFrame(rows, "doc_id int, label int, tokens array<string>, trains array<int>"), features.VectorOptions(ngram_max=1), 2)
    assert vectors.n_docs.tolist() == [4, 0] and vectors.vocabulary.to_pylist() == ["a"]
    assert (vectors.idf > 0).tolist() == [[True, False]]
    vectors.close()


def test_judged_fits_keep_no_weights(spark, docs):
    placed = docs.withColumns(models.leave_out("fold", 3))
    vectors = SharedVectors(placed, features.TFIDF, 3)
    grid = [(i, c) for c in (0.5, 2.0) for i in range(3)]
    expected = vectors.accuracies(vectors.minimise("logistic", [Fit(i, c) for i, c in grid], 1e-5))
    fits = vectors.minimise("logistic", [Fit(i, c) for i, c in grid], 1e-5, judge=True)
    assert [f.accuracy for f in fits] == pytest.approx(list(expected)) and all(f.weights is None for f in fits)
    vectors.close()


def test_blocks_hold_documents_of_the_same_sets():
    from reviewlytics.operators.solvers import _in_order

    member = np.array([[1, 0], [0, 1], [1, 0]], np.uint8)
    found = _in_order(member, np.array([2, 1, 0]), np.array([7, 8, 9], np.int32), np.empty(0), 0)
    assert [(some.tolist(), size.tolist(), term.tolist()) for some, size, term, _ in found] == [([1], [1], [9]), ([0, 2], [2, 0], [7, 8])]


def test_homes_of_transfer_take_turns(spark, tmp_path, monkeypatch):
    from reviewlytics.plans import model_queries

    texts = ["good fine film", "bad dull film", "good plot", "bad plot"]
    rows = [(i, texts[i % 4], f"l{i % 3}", f"s{i % 2}", 1 - i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")
    table.drop("quality").write.parquet(f"{tmp_path}/documents.parquet")
    table.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    seen, plain = [], models.shared_vectors
    monkeypatch.setattr(models, "shared_vectors", lambda name, docs, n_sets=1, n_parts=1: seen.append(n_sets) or plain(name, docs, n_sets, n_parts))
    found = model_queries.registry.queries["transfer"](spark, str(tmp_path)).collect()
    # The sets of one home at a time, its own and one per fold; all homes together were 18.
    assert seen == [6, 6, 6] and len(found) == 6


def test_small_sets_are_fitted_by_a_task_each(spark, docs, monkeypatch):
    vectors = SharedVectors(docs.withColumns(models.leave_out("fold", 3)), features.NBSVM, 3, ratio=True)
    grid = [(i, c) for c in (8.0, 0.5) for i in range(3)]
    monkeypatch.setattr("reviewlytics.operators.solvers.OWN_COUNTS", -1)
    expected = vectors.minimise("logistic", [Fit(i, c) for i, c in grid], 1e-9)
    right = vectors.accuracies(expected)
    monkeypatch.undo()
    # No pass of all tasks per product.
    monkeypatch.setattr(SharedVectors, "_sum", None)
    fits = vectors.minimise("logistic", [Fit(i, c) for i, c in grid], 1e-9)
    judged = vectors.minimise("logistic", [Fit(i, c) for i, c in grid], 1e-9, judge=True)
    vectors.close()
    for f, a, want, r in zip(fits, judged, expected, right, strict=True):
        assert (f.train, f.cost, f.n_docs, f.n_features, f.converged) == (want.train, want.cost, want.n_docs, want.n_features, True)
        assert np.abs(f.weights - want.weights).max() < 1e-6 and f.bias == pytest.approx(want.bias, abs=1e-6)
        assert f.gradient_at_zero == pytest.approx(want.gradient_at_zero) and a.accuracy == pytest.approx(r) and a.weights is None


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_own_set_in_blocks(monkeypatch, limit):
    from reviewlytics.operators import solvers

    monkeypatch.setattr(solvers, "SENT_COUNTS", limit)
    monkeypatch.setattr(solvers, "READ_COUNTS", limit)
    rng = np.random.default_rng(3)
    size = np.array([0, 3, 2, 0, 4, 1, 0])
    term, value, label = rng.integers(0, 6, 10), rng.choice([1.0, 1.5, 2.0], 10), rng.integers(0, 2, 7)
    trains = np.array([1, 1, 0, 1, 1, 1, 0], np.uint8)[:, None]
    block = solvers.Block(label, np.zeros(7, np.int32), trains, 1 - trains, size, term, value, {0: np.arange(1.0, 8.0)})
    scale = np.array([1.0, 2.0, 0.0, 1.0, 0.5, 3.0])
    own = solvers.OwnSet((row for _, row in solvers._dealt(block, [0], True)), scale)
    x = np.zeros((7, 6))
    np.add.at(x, (np.repeat(np.arange(7), size), term), value)
    x = np.column_stack((x * scale / np.arange(1.0, 8.0)[:, None], np.ones(7)))
    theta = rng.normal(size=7) * np.append(scale != 0, True)
    inside, y = trains[:, 0] == 1, label * 2.0 - 1
    short = np.append(theta[:-1][own.known], theta[-1])[None]
    loss, gradient, _ = own._sum(solvers._gradient, own._state("logistic", [Fit(0, 1.0)], short), [(1,), short.shape, short.shape])
    margin = (x @ theta)[inside] * y[inside]
    assert loss[0] == pytest.approx(np.logaddexp(0, -margin).sum())
    full = x[inside].T @ (-y[inside] / (1 + np.exp(margin)))
    got = gradient[0] * np.append(scale[own.known], 1.0)
    assert np.allclose(got, np.append(full[:-1][own.known], full[-1]))
    right, n = own._sum(solvers._hits, own._state("logistic", [Fit(0, 1.0)], short), [(1, 1), (1, 1)])
    assert n[0, 0] == 2 and right[0, 0] == ((x @ theta >= 0) == (label == 1))[~inside].sum()


def test_recipes_in_one_pass_equal_recipes_by_joins(spark, docs, monkeypatch):
    from reviewlytics.operators import naive_bayes
    from reviewlytics.plans import model_queries

    part = F.when(F.col("fold") == 0, "test").otherwise("train")
    short = F.filter("tokens", lambda x: x > "w15")
    both = docs.withColumn("fit", F.lit("whole")).unionByName(docs.withColumns({"fit": F.lit("some"), "tokens": short})).withColumn("part", part)
    twice = both.unionByName(both.filter("doc_id < 3"))
    options = features.VectorOptions(ngram_max=2)

    def rows(found):
        scored, sizes = found
        return sorted((r.fit, r.doc_id, r.label, round(r.score, 7), r.pred) for r in scored.collect()), sorted(map(tuple, sizes.select("fit", "n_features").collect()))

    joined = rows(model_queries._by_joins(both, options))
    repeated = rows(model_queries._by_joins(twice, options))
    assert rows(model_queries.recipe_runs(twice, 2)) == repeated
    monkeypatch.setattr(naive_bayes, "fit", None)
    assert rows(model_queries.recipe_runs(both, 2)) == joined


def test_disjoint_sets_count_their_own_terms(spark, docs):
    own = F.when(F.col("fold") < 2, F.array("fold", "fold")).otherwise(F.array().cast("array<int>"))
    vectors = SharedVectors(docs.withColumn("trains", own), features.TFIDF, 2)
    assert vectors._disjoint
    for i in (0, 1):
        alone = SharedVectors(docs.filter(F.col("fold") == i), features.TFIDF)
        known = vectors.idf[:, i] > 0
        assert vectors.vocabulary.filter(known).to_pylist() == alone.vocabulary.to_pylist()
        assert vectors.idf[known, i] == pytest.approx(alone.idf[:, 0])
        alone.close()
    vectors.close()
