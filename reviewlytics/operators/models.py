"""Logistic regression, linear SVM and NB-SVM: many fits in one solver; tuning and nested validation.

A trained model is turned into the weight table of :class:`reviewlytics.operators.linear.LinearModel`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.config import PARAM_GRIDS
from reviewlytics.operators import features as feat
from reviewlytics.operators import naive_bayes
from reviewlytics.operators.linear import LinearModel, score, with_prediction
from reviewlytics.operators.solvers import TOLERANCE, Fit, SharedVectors
from reviewlytics.runtime import lookup, settle

#: What the solvers minimise, beside half the squared weights and intercept.
LOSSES = {"linear_svm": "squared_hinge", "logistic_regression": "logistic", "nbsvm": "logistic"}


def options_of(name: str) -> feat.VectorOptions:
    return feat.NBSVM if name == "nbsvm" else feat.TFIDF


def shared_vectors(name: str, docs: DataFrame, n_sets: int = 1, n_parts: int = 1, kept: bool = True) -> SharedVectors:
    return SharedVectors(docs, options_of(name), n_sets, n_parts, ratio=name == "nbsvm", kept=kept)


def fit_all(name: str, vectors: SharedVectors, sets: list[int], grid, tolerance: float = TOLERANCE) -> list[Fit]:
    """A fit of each training set and grid point, sets changing fastest."""
    if name == "naive_bayes":
        return [f for f in vectors.naive_bayes(tuple(grid)) if f.train in sets]
    return vectors.minimise(LOSSES[name], [Fit(i, float(c)) for c in grid for i in sets], tolerance)


def judge_all(name: str, vectors: SharedVectors, sets: list[int], grid, tolerance: float = TOLERANCE) -> list[Fit]:
    """The same fits with their accuracy on what is held out for their set, in place of their weights."""
    if name == "naive_bayes":
        return vectors.judge(fit_all(name, vectors, sets, grid))
    return vectors.minimise(LOSSES[name], [Fit(i, float(c)) for c in grid for i in sets], tolerance, judge=True)


def as_linear(name: str, vectors: SharedVectors, fit: Fit) -> LinearModel:
    spark = vectors.spark
    bias = spark.createDataFrame([("all", fit.bias)], "fit string, bias double")
    meta = {
        "model": name, "parameter": fit.cost, "loss": fit.loss, "gradient": fit.gradient, "gradient_at_zero": fit.gradient_at_zero,
        "newton_steps": fit.newton_steps, "products": fit.products, "converged": fit.converged,
    }
    return LinearModel(settle(vectors.weight_table(fit), "weights"), bias, ["fit"], vectors.options, meta)


def train(name: str, docs: DataFrame, c: float, tolerance: float = TOLERANCE) -> LinearModel:
    """Fit one linear model on ``docs`` (doc_id, label, tokens)."""
    vectors = shared_vectors(name, docs)
    try:
        return as_linear(name, vectors, *fit_all(name, vectors, [0], (c,), tolerance))
    finally:
        vectors.close()


def train_naive_bayes(docs: DataFrame, alpha: float = 0.5) -> LinearModel:
    model = naive_bayes.fit(docs.withColumn("fit", F.lit("all")), ["fit"], (alpha,))
    model.meta["parameter"] = alpha
    return model


BUILDERS: dict[str, Callable[..., LinearModel]] = {
    "naive_bayes": train_naive_bayes,
    "linear_svm": lambda docs, c=0.5, **kw: train("linear_svm", docs, c, **kw),
    "logistic_regression": lambda docs, c=4.0, **kw: train("logistic_regression", docs, c, **kw),
    "nbsvm": lambda docs, c=1.0, **kw: train("nbsvm", docs, c, **kw),
}


def build_model(name: str, docs: DataFrame, *args, **kwargs) -> LinearModel:
    if name not in BUILDERS:
        raise KeyError(f"unknown model {name!r}; choose from {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name](docs, *args, **kwargs)


def predict(docs: DataFrame, model: LinearModel, keep: list[str]) -> DataFrame:
    """Score a table of tokens: ``doc_id, keep..., score, pred``."""
    return with_prediction(score(docs.withColumn("fit", F.lit("all")), model, keep)).drop("fit")


def leave_out(fold: str, k: int) -> dict:
    """Columns ``trains`` and ``held`` for ``k`` sets, each of all folds but one."""
    others = F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda i: i != F.col(fold))
    return {"trains": others, "held": F.array(F.col(fold).cast("int"))}


def some_sets(docs: DataFrame, first: int, n: int) -> DataFrame:
    """``docs`` with ``n`` of their training sets alone, from number ``first``, as 0 to n - 1, and without the rows that none of these uses.

    Many sets take turns this way: what the driver holds goes by the sets of a turn, and a pass over small sets reads few documents.
    """
    def own(c: str) -> Column:
        kept = F.filter(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda i: (i >= first) & (i < first + n))
        return F.transform(kept, lambda i: i - F.lit(first))

    return docs.withColumns({c: own(c) for c in ("trains", "held")}).filter(F.size("trains") + F.size("held") > 0)


def _report(fit: Fit) -> dict:
    share = fit.gradient / fit.gradient_at_zero if fit.gradient_at_zero else 0.0
    return {"parameter": fit.cost, "n_docs": fit.n_docs, "n_features": fit.n_features, "newton_steps": fit.newton_steps, "products": fit.products, "gradient_share": share, "converged": fit.converged}


def cross_validate(name: str, docs: DataFrame, k: int, grid=None, tolerance: float = TOLERANCE) -> pd.DataFrame:
    """``fold, accuracy, parameter`` and the solver's record over ``docs`` (doc_id, label, tokens, fold).

    Vocabulary, frequencies and ratio of a fold come from the other folds
    alone. All folds and grid points are fitted, and judged, together.
    """
    points = PARAM_GRIDS[name] if grid is None else grid
    vectors = shared_vectors(name, docs.withColumns(leave_out("fold", k)), k)
    try:
        fits = judge_all(name, vectors, list(range(k)), points, tolerance)
    finally:
        vectors.close()
    return pd.DataFrame([{"fold": f.train, "accuracy": f.accuracy, **_report(f)} for f in fits])


def best_parameter(runs: pd.DataFrame) -> tuple[float, float]:
    """Parameter with the highest mean accuracy (the smallest on ties), and that accuracy."""
    means = runs.groupby("parameter")["accuracy"].mean().round(9)
    return float(means.idxmax()), float(means.max())


def tune(name: str, docs: DataFrame, k: int = 5, grid=None, tolerance: float = TOLERANCE) -> LinearModel:
    """Choose the parameter by cross-validation and refit on everything."""
    parameter, accuracy = best_parameter(cross_validate(name, docs, k, grid, tolerance))
    model = train_naive_bayes(docs, parameter) if name == "naive_bayes" else train(name, docs, parameter, tolerance)
    model.meta["cv_accuracy"] = accuracy
    return model


def nested_accuracy(
    name: str, docs: DataFrame, outer: int = 5, inner: int = 3, grid=None, tolerance: float = TOLERANCE
) -> pd.DataFrame:
    """Accuracy per outer fold of a model tuned on the other folds only.

    ``docs`` has ``stratum_rank``; both levels of folds follow from it. The
    inner fits of all outer folds are one run of the solver, the refits another.
    """
    points = PARAM_GRIDS[name] if grid is None else grid
    rank = F.col("stratum_rank") - 1
    out, own = (rank % outer).cast("int"), (F.floor(rank / outer) % inner).cast("int")
    # Set o * inner + i: outer fold o is left out, and i of the rest; set outer * inner + o: outer fold o alone.
    sets = [(o, i) for o in range(outer) for i in range(inner)] + [(o, None) for o in range(outer)]

    def chosen(rule) -> Column:
        return F.array_compact(F.array(*[F.when(rule(o, i), F.lit(n)) for n, (o, i) in enumerate(sets)]))

    placed = docs.withColumns({
        "trains": chosen(lambda o, i: (out != o) & (F.lit(True) if i is None else own != i)),
        "held": chosen(lambda o, i: out == o if i is None else (out != o) & (own == i)),
    })
    vectors = shared_vectors(name, placed, len(sets))
    try:
        fits = judge_all(name, vectors, list(range(outer * inner)), points, tolerance)
        runs = pd.DataFrame([{"outer": sets[f.train][0], "parameter": f.cost, "accuracy": f.accuracy} for f in fits])
        best = [best_parameter(runs[runs["outer"] == o])[0] for o in range(outer)]
        if name == "naive_bayes":
            refits = [f for f in vectors.naive_bayes(tuple(points)) for o in range(outer) if f.train == outer * inner + o and f.cost == best[o]]
        else:
            refits = vectors.minimise(LOSSES[name], [Fit(outer * inner + o, best[o]) for o in range(outer)], tolerance)
        right = vectors.accuracies(refits)
    finally:
        vectors.close()
    return pd.DataFrame([
        {"fold": sets[f.train][0], "accuracy": float(a), **_report(f)} for f, a in zip(refits, right, strict=True)
    ]).sort_values("fold", ignore_index=True)


@dataclass
class Tuned:
    """A model chosen by cross-validation, refitted on all training rows; ``runs`` are its folds and grid points."""

    model: LinearModel
    runs: pd.DataFrame
    parameter: float
    cv_accuracy: float
    accuracy: float


def tune_all(docs: DataFrame, k: int = 5, names=tuple(PARAM_GRIDS), grids=None, tolerance: float = TOLERANCE) -> dict[str, Tuned]:
    """Every model tuned on the training rows of one split, and its accuracy on the rest.

    ``docs``: doc_id, label, tokens, ``part`` (train or test), ``fold`` (0 to
    k - 1, read for training rows). Models of one vocabulary share its vectors;
    folds, grid points and refits are sets of the same documents.
    """
    grids = grids or PARAM_GRIDS
    train, none = F.col("part") == "train", F.array().cast("array<int>")
    others = F.concat(leave_out("fold", k)["trains"], F.array(F.lit(k)))
    placed = docs.withColumns({
        "trains": F.when(train, others).otherwise(none),
        "held": F.when(train, F.array(F.col("fold").cast("int"))).otherwise(F.array(F.lit(k))),
    })
    out: dict[str, Tuned] = {}
    for shared in ([n for n in names if n != "nbsvm"], [n for n in names if n == "nbsvm"]):
        if not shared:
            continue
        vectors = shared_vectors(shared[0], placed, k + 1)
        try:
            for name in shared:
                fits = judge_all(name, vectors, list(range(k)), grids[name], tolerance)
                runs = pd.DataFrame([{"fold": f.train, "accuracy": f.accuracy, **_report(f)} for f in fits])
                parameter, cv_accuracy = best_parameter(runs)
                refit = fit_all(name, vectors, [k], (parameter,), tolerance)
                model = as_linear(name, vectors, *refit)
                model.meta["cv_accuracy"] = cv_accuracy
                out[name] = Tuned(model, runs, parameter, cv_accuracy, float(vectors.accuracies(refit)[0]))
        finally:
            vectors.close()
    return out


def _slope(kind: str, label, margin):
    """Derivative of the loss by the margin."""
    y = F.lit(2.0) * label - F.lit(1.0)
    if kind == "squared_hinge":
        return F.lit(-2.0) * y * F.greatest(F.lit(0.0), F.lit(1.0) - y * margin)
    return -y / (F.lit(1.0) + F.exp(y * margin))


def stationarity(docs: DataFrame, model: LinearModel, kind: str, cost: float) -> DataFrame:
    """How far a weight table is from the least penalised loss: one row, n_docs, n_terms, gradient, gradient_at_zero.

    Recomputed from the table by joins and sums, without the solver: each
    document's margin, the slope of its loss, and the slopes summed over the
    documents of each term. A term's penalised weight is its effective weight
    without the ratio. ``docs``: doc_id, label, tokens.
    """
    weights = model.weights.select("term", "idf", "ratio", "weight")
    terms = feat.term_rows(docs, ["doc_id", "label"], model.options.ngram_max, outer=True)
    x = feat.tf_weight(F.col("tf"), model.options) * F.col("idf")
    rows = settle(lookup(terms, weights, ["term"], "left").select("doc_id", "label", "term", "ratio", "weight", x.alias("x")), "weighted-terms")
    bias = model.bias.first()["bias"]
    length = F.coalesce(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1.0)) if model.options.normalise else F.lit(1.0)
    sums = rows.groupBy("doc_id", "label").agg(F.coalesce(F.sum(F.col("x") * F.col("weight")), F.lit(0.0)).alias("dot"), length.alias("length"))
    label = F.col("label").cast("double")
    slopes = settle(sums.select(
        "doc_id", "length", _slope(kind, label, F.lit(bias) + F.col("dot") / F.col("length")).alias("slope"), _slope(kind, label, F.lit(0.0)).alias("slope_0"),
    ), "slopes")
    known = rows.filter("x is not null").select("doc_id", "term", "ratio", "x").join(slopes, "doc_id")
    per_term = known.groupBy("term").agg(*[
        (F.sum(F.col("x") / F.col("length") * F.col(s) * F.col("ratio")) * F.lit(float(cost))).alias(s) for s in ("slope", "slope_0")
    ])
    own = F.when(F.col("ratio") == 0, F.lit(0.0)).otherwise(F.col("weight") / F.col("ratio"))
    judged = weights.join(per_term, "term", "left").agg(
        F.count("*").alias("n_terms"), F.sum((own + F.coalesce("slope", F.lit(0.0))) ** 2).alias("g"), F.sum(F.coalesce("slope_0", F.lit(0.0)) ** 2).alias("g_0"),
    )
    whole = slopes.agg(F.count("*").alias("n_docs"), F.sum("slope").alias("b"), F.sum("slope_0").alias("b_0"))
    c = F.lit(float(cost))
    return judged.crossJoin(whole).select(
        "n_docs", "n_terms", F.sqrt(F.col("g") + (F.lit(bias) + c * F.col("b")) ** 2).alias("gradient"),
        F.sqrt(F.col("g_0") + (c * F.col("b_0")) ** 2).alias("gradient_at_zero"),
    )


def score_with(df: DataFrame, make_predict, text: str = "text", batch_size: int = 64) -> DataFrame:
    """Add ``score`` from any model that maps a batch of raw texts to [0, 1].

    ``make_predict`` is called once per worker process and loads the model; it
    returns a function from an array of texts to an array of numbers.
    """
    scorer = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size)
    return df.withColumn("score", scorer(F.col(text)))
