"""Models trained by iterative solvers: their fits are certified in SQL, their rows checked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reviewlytics.config import DIAGNOSTIC_CASES, MODEL_DISPLAY_NAMES, PARAM_GRIDS, SEED
from reviewlytics.operators import evaluate, isotonic, linear, models, reports, sampling
from reviewlytics.operators.normalise import DEFAULT, PRESCRIBED, RAW, normalise
from reviewlytics.operators.ranking import rank_by_hash
from reviewlytics.plans import sql as s
from reviewlytics.plans.base import Registry, curve_draws, derived_lemmas, documents, folded_tokens, out_of_fold, review_tokens, reviews, turns
from reviewlytics.plans.model_queries import SPLIT, _lexicon_scored
from reviewlytics.plans.report_queries import _edge_bin
from reviewlytics.runtime import lookup, settle

registry = Registry()
add = registry.add
#: A certified gradient is this small beside the one at zero.
STATIONARY = 1e-6
FOLDS, INNER = 5, 3
COSTS = {"linear_svm": 0.5, "logistic_regression": 4.0, "nbsvm": 1.0}
_models: dict[tuple, object] = {}


def _once(spark, folder, name: str, build):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _models:
        _models[key] = build()
    return _models[key]


def forget_models() -> None:
    _models.clear()


def _split(spark, folder):
    """Reviews with their part, and the fold of those in training."""
    first = F.floor(F.col("stratum_size") * F.lit(0.2) + F.lit(0.5))
    fold = F.pmod(F.col("stratum_rank") - first - 1, F.lit(FOLDS)).cast("int")
    return review_tokens(spark, folder).withColumns({"part": sampling.split_part(), "fold": fold})


def _parts(spark, folder):
    docs = _split(spark, folder)
    cols = ["doc_id", "label", "corpus", "tokens", "terms_2"]
    return docs.filter("part = 'train'").select(cols), docs.filter("part = 'test'").select(cols)


def trained(spark, folder, name: str) -> linear.LinearModel:
    train, _test = _parts(spark, folder)
    return _once(spark, folder, name, lambda: models.build_model(name, train.select("doc_id", "label", "tokens", "terms_2")))


def held_out_scores(spark, folder, name: str):
    _train, test = _parts(spark, folder)
    return models.predict(test, trained(spark, folder, name), ["label"])


@add("logistic_regression_scores")
def _(spark, folder):
    return held_out_scores(spark, folder, "logistic_regression")


@add("linear_svm_scores")
def _(spark, folder):
    return held_out_scores(spark, folder, "linear_svm")


@add("nbsvm_scores")
def _(spark, folder):
    return held_out_scores(spark, folder, "nbsvm")


@add("nbsvm_top_terms")
def _(spark, folder):
    return linear.top_terms(trained(spark, folder, "nbsvm"), 18)


@add("nbsvm_explained")
def _(spark, folder):
    _train, test = _parts(spark, folder)
    docs = test.withColumn("fit", F.lit("all"))
    return linear.explain(docs, trained(spark, folder, "nbsvm")).select("doc_id", "side", "term", "contribution", "rank")


SOLVER_TRAIN = """solver_train AS MATERIALIZED (
  SELECT 'all' AS fit, t.doc_id, t.label, t.tokens FROM review_tokens t JOIN split p USING (doc_id) WHERE p.part = 'train')"""
_CERTIFIED = " UNION ALL ".join(
    f"SELECT '{name}' AS model, {cost} AS cost, (SELECT count(*) FROM solver_train) AS n_docs, "
    f"(SELECT count(*) FROM {'bi' if name == 'nbsvm' else 'ti'}_vocab) AS n_terms, TRUE AS stationary" for name, cost in COSTS.items()
)


@add("solver_certificates", s.with_(
    s.REVIEWS, s.LABELLED, s.TOKENS, SPLIT, SOLVER_TRAIN, s.tfidf("ti", "solver_train"),
    s.tfidf("bi", "solver_train", tf="binary", idf=False)) + _CERTIFIED)
def _(spark, folder):
    """Each solver's weight table is where its penalised loss is least: the gradient, recomputed by joins, vanishes."""
    train, _test = _parts(spark, folder)
    out = None
    for name, cost in COSTS.items():
        found = models.stationarity(train, trained(spark, folder, name), models.LOSSES[name], cost)
        row = found.select(
            F.lit(name).alias("model"), F.lit(cost).alias("cost"), "n_docs", "n_terms",
            (F.col("gradient") <= F.lit(STATIONARY) * F.col("gradient_at_zero")).alias("stationary"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# -- tuned models on one split ------------------------------------------------------- #
def tuned(spark, folder) -> dict[str, models.Tuned]:
    docs = _split(spark, folder).select("doc_id", "label", "tokens", "terms_2", "part", "fold")
    return _once(spark, folder, "tuned", lambda: models.tune_all(docs, FOLDS))


def best_model(spark, folder) -> str:
    """The model of highest cross-validated accuracy, of equal ones the first by name."""
    found = tuned(spark, folder)
    return min(found, key=lambda n: (-round(found[n].cv_accuracy, 9), n))


def _tuned_scores(spark, folder):
    """Test reviews under every tuned model and the lexicon: model, doc_id, label, score, pred."""
    def build():
        _train, test = _parts(spark, folder)
        out = _lexicon_scored(spark, folder).join(test.select("doc_id"), "doc_id", "left_semi").select(
            F.lit("lexicon").alias("model"), "doc_id", "label", "score", "pred"
        )
        for name, one in tuned(spark, folder).items():
            scored = models.predict(test, one.model, ["label"])
            out = out.unionByName(scored.select(F.lit(name).alias("model"), "doc_id", "label", "score", "pred"))
        return settle(out, "tuned-scores")

    return _once(spark, folder, "tuned-scores", build)


def _comparison(spark, folder, scored):
    names = F.create_map(*[F.lit(x) for pair in MODEL_DISPLAY_NAMES.items() for x in pair])
    rows = [(n, t.parameter, t.cv_accuracy, n == best_model(spark, folder)) for n, t in tuned(spark, folder).items()]
    chosen = spark.createDataFrame(rows, "model string, parameter double, cv_accuracy double, deployed boolean")
    metrics = evaluate.compute_metrics(scored, ["model"]).join(F.broadcast(chosen), "model", "left")
    return metrics.withColumn("display_name", names[F.col("model")]).select(
        "model", "display_name", "n", "accuracy", "ci_low", "ci_high", "f1_macro", "roc_auc", "average_precision",
        "parameter", "cv_accuracy", F.coalesce("deployed", F.lit(False)).alias("deployed"),
    )


@add("four_model_comparison")
def _(spark, folder):
    return _comparison(spark, folder, _tuned_scores(spark, folder).filter("model <> 'lexicon'"))


@add("five_model_comparison")
def _(spark, folder):
    """The tuned models and the lexicon on the test reviews, most accurate first."""
    return _comparison(spark, folder, _tuned_scores(spark, folder)).orderBy(F.desc("accuracy"), "model")


@add("four_model_mcnemar")
def _(spark, folder):
    """Every model against the one that is most accurate on the test reviews."""
    return evaluate.mcnemar(_tuned_scores(spark, folder))


@add("recipe_test_best_model")
def _(spark, folder):
    """The best model under the default and the prescribed recipe, on the same test reviews, with the paired test."""
    name = best_model(spark, folder)
    texts = reviews(spark, folder).select("doc_id", "label", "text", sampling.split_part().alias("part"))
    out = None
    for kind, recipe in (("default", DEFAULT), ("prescribed", PRESCRIBED)):
        docs = settle(normalise(texts, recipe, lemmas=derived_lemmas(spark, folder)).select("doc_id", "label", "part", "tokens"), "recipe")
        model = models.build_model(name, docs.filter("part = 'train'"), tuned(spark, folder)[name].parameter)
        scored = models.predict(docs.filter("part = 'test'"), model, ["label"]).select(F.lit(kind).alias("recipe"), "doc_id", "label", "pred")
        out = scored if out is None else out.unionByName(scored)
    out = settle(out, "two-recipes")
    rated = out.groupBy(F.col("recipe")).agg(F.count("*").alias("n"), F.avg(reports.right()).alias("accuracy"))
    test = evaluate.mcnemar(out, "default", "recipe").select("n01", "n10", "p_value")
    return rated.crossJoin(F.broadcast(test)).select(F.lit(name).alias("model"), "recipe", "n", "accuracy", "n01", "n10", "p_value")


def _curve_folds(size: int) -> int:
    """Folds that tune a model inside a draw: fewer where they would be tiny."""
    return 3 if size < 1_000 else 5


def _curve_sets(spark, folder):
    """Reviews with the sets of every draw: one per fold left out, then the whole draw, which is judged on the test reviews."""
    tokens = _split(spark, folder).select("doc_id", "label", "terms_2", "part")
    pool = tokens.filter("part = 'train'").select("doc_id", "label")
    total = pool.count()
    draws, sets = [], 0
    for size, repeats in curve_draws(total).items():
        for draw in range(repeats):
            draws.append((size, draw, sets, _curve_folds(size)))
            sets += _curve_folds(size) + 1
    drawn = sampling.stratified_subsamples(pool, curve_draws(total), total)
    ranked = rank_by_hash(drawn, ["train_size", "draw", "label"], "doc_id", SEED, "_rank")
    plan = spark.createDataFrame(draws, "train_size int, draw int, first int, k int")
    placed = lookup(ranked, plan, ["train_size", "draw"]).withColumn("fold", (F.col("first") + (F.col("_rank") - 1) % F.col("k")).cast("int"))
    others = F.filter(F.sequence(F.col("first"), F.col("first") + F.col("k")), lambda i: i != F.col("fold"))
    by_doc = placed.groupBy("doc_id").agg(F.flatten(F.collect_list(others)).alias("trains"), F.collect_list("fold").alias("inside"))
    wholes = F.array(*[F.lit(first + k) for _, _, first, k in draws])
    held = F.when(F.col("part") == "test", wholes).otherwise(F.coalesce("inside", F.array().cast("array<int>")))
    return draws, sets, settle(tokens.join(by_doc, "doc_id", "left").withColumn("held", held).drop("inside"), "curve-sets")


@add("learning_curve_models")
def _(spark, folder):
    """Accuracy by training size of the four models, each tuned by cross-validation inside every draw."""
    all_draws, _, all_docs = _curve_sets(spark, folder)
    rows = []
    for some in turns([(size, k + 1) for size, _, _, k in all_draws]):
        start = all_draws[some[0]][2]
        draws = [(size, draw, first - start, k) for size, draw, first, k in (all_draws[i] for i in some)]
        sets = sum(k + 1 for _, _, _, k in draws)
        docs = models.some_sets(all_docs, start, sets)
        inner = [first + j for _, _, first, k in draws for j in range(k)]
        for shared in (("naive_bayes", "linear_svm", "logistic_regression"), ("nbsvm",)):
            vectors = models.shared_vectors(shared[0], docs, sets)
            for name in shared:
                fits = models.judge_all(name, vectors, inner, PARAM_GRIDS[name])
                runs = pd.DataFrame({"set": [f.train for f in fits], "parameter": [f.cost for f in fits], "accuracy": [f.accuracy for f in fits]})
                chosen = []
                for size, _draw, first, k in draws:
                    best, _ = models.best_parameter(runs[runs["set"].between(first, first + k - 1)])
                    chosen.append((name, size, first + k, best))
                whole = [f for best in sorted({r[3] for r in chosen}) for f in models.fit_all(name, vectors, [r[2] for r in chosen if r[3] == best], (best,))]
                found = {f.train: (float(a), float(f.n_features)) for f, a in zip(whole, vectors.accuracies(whole), strict=True)}
                rows += [(*r, *found[r[2]]) for r in chosen]
            vectors.close()
    runs = spark.createDataFrame(
        [(name, size, accuracy, n, best) for name, size, _, best, accuracy, n in rows],
        "model string, train_size int, accuracy double, n_features double, parameter double",
    )
    return reports.learning_curve(runs)


def _grid(spark, folder) -> pd.DataFrame:
    return _once(spark, folder, "grid", lambda: models.cross_validate("nbsvm", folded_tokens(spark, folder, FOLDS), FOLDS))


@add("nbsvm_grid_search")
def _(spark, folder):
    """Accuracy per fold and cost, with the solver's record; ``chosen`` marks the cost that is refitted."""
    runs = _grid(spark, folder).copy()
    runs["chosen"] = runs["parameter"] == models.best_parameter(runs)[0]
    return spark.createDataFrame(runs)


_COSTS = ", ".join(f"({c})" for c in PARAM_GRIDS["nbsvm"])


@add("nbsvm_grid_fits", s.with_(s.REVIEWS, s.LABELLED, s.TOKENS, f"""{s.folds(FOLDS)},
grid_train AS MATERIALIZED (
  SELECT f.fit, t.doc_id, t.label, t.tokens FROM (SELECT * FROM review_tokens JOIN folds USING (doc_id)) t,
    (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fit) f WHERE t.fold <> f.fit)""",
    s.tfidf("gr", "grid_train", tf="binary", idf=False)) + f"""
SELECT fit AS fold, CAST(parameter AS DOUBLE) AS parameter, CAST(n_docs AS BIGINT) AS n_docs, n_features, TRUE AS converged
FROM gr_sizes JOIN (SELECT fit, count(*) AS n_features FROM gr_vocab GROUP BY fit) USING (fit), (VALUES {_COSTS}) g(parameter)""")
def _(spark, folder):
    """What each fit of the grid was trained on, and that it went to the tolerance."""
    runs = _grid(spark, folder)
    return spark.createDataFrame(
        runs[["fold", "parameter", "n_docs", "n_features", "converged"]], "fold int, parameter double, n_docs long, n_features long, converged boolean",
    )


@add("nbsvm_nested_cv")
def _(spark, folder):
    return spark.createDataFrame(models.nested_accuracy("nbsvm", review_tokens(spark, folder), FOLDS, INNER))


@add("nbsvm_transfer")
def _(spark, folder):
    """NB-SVM of each corpus, tuned at home, on every other corpus; the reference is nested validation at home."""
    docs = review_tokens(spark, folder)
    corpora = [r[0] for r in docs.select("corpus").distinct().orderBy("corpus").collect()]
    rows, reference = [], []
    for home in corpora:
        own = F.col("corpus") == home
        ranked = sampling.stratum_ranks(docs.filter(own).select("doc_id", "label", "terms_2"))
        at_home = settle(ranked, "home")
        reference.append((home, float(models.nested_accuracy("nbsvm", at_home, FOLDS, INNER)["accuracy"].mean())))
        cost, _ = models.best_parameter(models.cross_validate("nbsvm", at_home.withColumn("fold", sampling.fold_number(FOLDS)), FOLDS))
        place = F.array_position(F.array(*[F.lit(c) for c in corpora]), F.col("corpus")) - 1
        none = F.array().cast("array<int>")
        placed = docs.select("label", "terms_2", F.when(own, F.array(F.lit(0))).otherwise(none).alias("trains"),
                             F.when(own, none).otherwise(F.array(F.lit(0))).alias("held"), place.cast("int").alias("slice"))
        vectors = models.shared_vectors("nbsvm", placed, 1, len(corpora))
        right, n = vectors.hits(models.fit_all("nbsvm", vectors, [0], (cost,)))
        vectors.close()
        rows += [(home, c, int(m), float(r / m)) for c, r, m in zip(corpora, right[:, 0], n[:, 0], strict=True) if m]
    metrics = spark.createDataFrame(rows, "trained_on string, evaluated_on string, n long, accuracy double")
    return reports.transfer_table(metrics, spark.createDataFrame(reference, "evaluated_on string, reference_accuracy double"))


_HASH = s.md5(SEED, "doc_id")
ISOTONIC = f"""calibration AS MATERIALIZED (
  SELECT doc_id, label, score, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, doc_id)
    > floor(count(*) OVER (PARTITION BY label) * 0.8 + 0.5) AS used FROM scored),
pooled AS (SELECT score, CAST(sum(label) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM calibration WHERE used GROUP BY score),
sums AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY score) AS k, score, y, n, sum(y) OVER (ORDER BY score) AS sy, sum(n) OVER (ORDER BY score) AS sn FROM pooled),
stretches AS MATERIALIZED (SELECT a.k AS i, b.k AS j, (b.sy - a.sy + a.y) / (b.sn - a.sn + a.n) AS m FROM sums a JOIN sums b ON a.k <= b.k),
isotonic AS MATERIALIZED (
  SELECT k, score AS x, max(least_mean) AS v FROM (
    SELECT p.k, p.score, s.i, min(s.m) AS least_mean FROM sums p JOIN stretches s ON s.i <= p.k AND s.j >= p.k GROUP BY p.k, p.score, s.i)
  GROUP BY k, score),
rest AS (SELECT doc_id, label, score FROM calibration WHERE NOT used),
around AS (
  SELECT rest.label, rest.score, lo.x AS x0, lo.v AS v0, hi.x AS x1, hi.v AS v1
  FROM rest ASOF LEFT JOIN isotonic lo ON rest.score >= lo.x ASOF LEFT JOIN isotonic hi ON rest.score <= hi.x),
both_scores AS MATERIALIZED (
  SELECT 'raw model output' AS scores, label, score FROM rest
  UNION ALL SELECT 'isotonic recalibration', label, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x0 = x1 THEN v0
    ELSE v0 + (v1 - v0) * (score - x0) / (x1 - x0) END FROM around),
sure AS (
  SELECT scores, CASE WHEN score >= 0.5 THEN score ELSE CAST(1.0 AS DOUBLE) - score END AS c,
    CAST(CAST(score >= 0.5 AS INTEGER) = label AS DOUBLE) AS ok FROM both_scores),
bins AS (SELECT scores, {_edge_bin('c', evaluate.CONFIDENCE_EDGES, True)} AS bin, count(*) AS n, avg(ok) AS acc, avg(c) AS conf FROM sure GROUP BY ALL)"""


@add("isotonic_calibration", s.with_(s.OUT_OF_FOLD, ISOTONIC) + s.rounded("""
SELECT * FROM (SELECT scores, coalesce(sum(n * abs(acc - conf)) FILTER (bin IS NOT NULL), 0.0) / sum(n) AS ece FROM bins GROUP BY scores)
  JOIN (SELECT scores, avg(CAST(CAST(score >= 0.5 AS INTEGER) = label AS DOUBLE)) AS accuracy,
    100.0 * avg(CAST(score > 0.99 OR score < 0.01 AS DOUBLE)) AS share_beyond_99_pct FROM both_scores GROUP BY scores) USING (scores)""",
    "ece", "accuracy", "share_beyond_99_pct"))
def _(spark, folder):
    """Recalibration fitted on a fifth of the scored reviews, judged on the rest."""
    parts = settle(sampling.stratified_split(
        out_of_fold(spark, folder).select("doc_id", "label", "score"), test_share=0.8
    ), "calibration")
    rest = parts.filter("part = 'test'")
    calibrated = isotonic.fit_isotonic(parts.filter("part = 'train'")).transform(rest)
    return evaluate.calibration_table(rest, calibrated.select("label", F.col("calibrated").alias("score")))


@add("batch_scorer", """
    SELECT doc_id, round(1.0 / (1.0 + exp(-(length(text) - 1000) / 1000.0)), 6) AS score FROM documents""")
def _(spark, folder):
    """A caller's own model over raw text, here one that looks at the length."""
    def make_predict():
        def predict(texts: np.ndarray) -> np.ndarray:
            lengths = np.array([len(t) for t in texts], dtype=float)
            return 1.0 / (1.0 + np.exp(-(lengths - 1000.0) / 1000.0))

        return predict

    return models.score_with(documents(spark, folder).select("doc_id", "text"), make_predict).select("doc_id", "score")


@add("diagnostic_cases")
def _(spark, folder):
    """Constructed reviews under the model of the given ones, with their strongest terms."""
    cases = spark.createDataFrame(list(DIAGNOSTIC_CASES), "doc_id string, text string")
    docs = normalise(cases, RAW).withColumn("fit", F.lit("all"))
    model = trained(spark, folder, "nbsvm")
    scored = models.predict(docs, model, [])
    best = linear.explain(docs, model, 4).filter("side = 'positive'").groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ")
        .alias("decisive_terms")
    )
    return scored.join(best, "doc_id", "left").select(
        F.col("doc_id").alias("phenomenon"), linear.sentiment(F.col("score")).alias("predicted"), "score",
        linear.confidence(F.col("score")).alias("confidence"), "decisive_terms",
    )


