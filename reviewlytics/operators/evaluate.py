"""Metrics of scored tables as aggregates, for one model or many (``by``).

A scored table has ``by..., doc_id, label, score, pred``. ``by`` must name at
least one column (for example ``model``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.config import LABEL_NAMES
from reviewlytics.functions.stats import mcnemar_p_value, share_interval
from reviewlytics.operators.ranking import rounded_score, running_totals

CONFIDENCE_EDGES = tuple(float(e) for e in np.linspace(0.5, 1.0, 11))
SCORE_EDGES = tuple(float(e) for e in np.linspace(0.0, 1.0, 11))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, zero where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """The four cells, one row per group."""
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("pred") == p))
    return scored.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def normalised_confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    """One row per true label; shares of each prediction within it."""
    return scored.groupBy(*by, "label").agg(
        F.count("*").alias("n"),
        F.avg((F.col("pred") == 0).cast("double")).alias("share_pred_0"),
        F.avg((F.col("pred") == 1).cast("double")).alias("share_pred_1"),
    )


def class_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and F1 of each class."""
    c = confusion(scored, by)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    f1_pos, f1_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    half = F.lit(0.5)
    return c.select(
        *by,
        (tn + fp + fn + tp).alias("n"),
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ((ratio(tp, tp + fp) + ratio(tn, tn + fn)) * half).alias("precision_macro"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) * half).alias("recall_macro"),
        ((f1_pos + f1_neg) * half).alias("f1_macro"),
        f1_pos.alias("f1_positive"), f1_neg.alias("f1_negative"),
        "tn", "fp", "fn", "tp",
    )


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Exact area under the ROC curve; ties count one half.

    NULL where a group has only one class.
    """
    sums = running_totals(_as_counts(scored), by, "score", ["pos", "neg"])
    gain = F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    return sums.groupBy(*by).agg(
        (F.sum(gain) / F.nullif(F.first("pos_total") * F.first("neg_total"), F.lit(0)).cast("double"))
        .alias("roc_auc")
    )


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """Step sum of precision over recall, from the highest score down."""
    sums = running_totals(_as_counts(scored), by, "score", ["pos", "neg"], descending=True)
    hits = F.col("pos_before") + F.col("pos")
    taken = hits + F.col("neg_before") + F.col("neg")
    step = F.col("pos") * hits.cast("double") / taken.cast("double")
    return sums.groupBy(*by).agg(
        (F.sum(step) / F.nullif(F.first("pos_total"), F.lit(0)).cast("double")).alias("average_precision")
    )


def roc_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """One point per distinct score, used as the threshold."""
    sums = running_totals(_as_counts(scored), by, "score", ["pos", "neg"], descending=True)
    return sums.select(
        *by, F.col("score").alias("threshold"),
        ratio(F.col("neg_before") + F.col("neg"), F.col("neg_total")).alias("fpr"),
        ratio(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("tpr"),
    )


def _as_counts(scored: DataFrame) -> DataFrame:
    return scored.withColumns({
        "score": rounded_score(F.col("score")),
        "pos": (F.col("label") == 1).cast("bigint"),
        "neg": (F.col("label") == 0).cast("bigint"),
    })


def accuracy_interval(scored: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy with its 95% percentile interval, from two counts per group."""
    hits = F.count_if(F.col("pred") == F.col("label"))
    counts = scored.groupBy(*by).agg(F.count("*").alias("n"), hits.alias("hits"))
    return counts.withColumn("ci", share_interval(F.col("n"), F.col("hits"))).select(
        *by, "n", ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"),
    )


def compute_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """The full metric record, one row per group."""
    interval = accuracy_interval(scored, by).select(*by, "ci_low", "ci_high")
    return (
        class_metrics(scored, by).join(roc_auc(scored, by), by)
        .join(average_precision(scored, by), by).join(interval, by)
    )


def class_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support: each class, macro and weighted."""
    c = confusion(scored, by)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def line(name, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("class"), ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"),
        )

    per_class = c.select(*by, F.inline(F.array(
        line(LABEL_NAMES[0], tn, fn, fp), line(LABEL_NAMES[1], tp, fp, fn)
    )))
    measures = ("precision", "recall", "f1")
    means = per_class.groupBy(*by).agg(
        *[F.avg(m).alias(f"m_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in measures],
        F.sum("support").alias("support"),
    )
    rows = [per_class]
    for name, prefix in (("macro avg", "m_"), ("weighted avg", "w_")):
        rows.append(means.select(
            *by, F.lit(name).alias("class"), *[F.col(prefix + m).alias(m) for m in measures], "support"
        ))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def mcnemar(predictions: DataFrame, best: str | None = None, model: str = "model") -> DataFrame:
    """Exact McNemar test of every other model against ``best``.

    ``predictions`` is long: model, doc_id, label, pred. Without ``best``, it is
    the model of highest accuracy, of equal ones the last by name.
    """
    right = F.col("pred") == F.col("label")
    if best is None:
        accuracy = predictions.groupBy(model).agg(F.avg(right.cast("int")).alias("_right"))
        best = accuracy.agg(F.max_by(model, F.struct("_right", model))).first()[0]
    ours = predictions.filter(F.col(model) == best).select("doc_id", right.alias("_a"))
    theirs = predictions.filter(F.col(model) != best).select(model, "doc_id", right.alias("_b"))
    counts = theirs.join(ours, "doc_id").groupBy(model).agg(
        F.count_if(F.col("_a") & ~F.col("_b")).alias("n01"),
        F.count_if(~F.col("_a") & F.col("_b")).alias("n10"),
    )
    tested = counts.withColumn("p_value", mcnemar_p_value(F.col("n01"), F.col("n10")))
    return tested.select(
        F.concat(F.lit(f"{best} vs "), model).alias("comparison"), "n01", "n10", "p_value",
        (F.col("p_value") < F.lit(0.05)).alias("significant_at_05"),
    )


def _bin(value: Column, edges, right_closed: bool) -> Column:
    """Index of the bin between two edges, NULL outside all of them."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low, high = F.lit(edges[i]), F.lit(edges[i + 1])
        inside = (value > low) & (value <= high) if right_closed else (value >= low) & (value < high)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def expected_calibration_error(scored: DataFrame, by: list[str]) -> DataFrame:
    """Gap between confidence and accuracy over ten bins of (0.5, 1].

    A confidence of exactly one half is in no bin but counts in the size.
    """
    score = F.col("score")
    sure = F.when(score >= F.lit(0.5), score).otherwise(F.lit(1.0) - score)
    right = ((score >= F.lit(0.5)).cast("int") == F.col("label")).cast("double")
    bins = scored.groupBy(*by, _bin(sure, CONFIDENCE_EDGES, True).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(right).alias("acc"), F.avg(sure).alias("sure")
    )
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("sure")))
    return bins.groupBy(*by).agg(
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def reliability_curve(scored: DataFrame, by: list[str], min_size: int = 30) -> DataFrame:
    """Mean score and share of positives per tenth of [0, 1)."""
    bins = scored.withColumn("bin", _bin(F.col("score"), SCORE_EDGES, False)).filter("bin IS NOT NULL")
    return (
        bins.groupBy(*by, "bin")
        .agg(F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive_rate"),
             F.count("*").alias("n"))
        .filter(F.col("n") >= min_size)
    )


def extreme_share(scored: DataFrame, by: list[str]) -> DataFrame:
    """Percentage of scores above 0.99 or below 0.01."""
    extreme = (F.col("score") > F.lit(0.99)) | (F.col("score") < F.lit(0.01))
    return scored.groupBy(*by).agg(
        (F.avg(extreme.cast("double")) * F.lit(100.0)).alias("share_beyond_99_pct")
    )


def calibration_table(scored: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Error, accuracy and saturation before and after recalibration."""
    both = scored.select(F.lit("raw model output").alias("scores"), "label", "score").unionByName(
        calibrated.select(F.lit("isotonic recalibration").alias("scores"), "label", "score")
    ).withColumn("pred", (F.col("score") >= F.lit(0.5)).cast("int"))
    by = ["scores"]
    return (
        expected_calibration_error(both, by).select("scores", "ece")
        .join(class_metrics(both, by).select("scores", "accuracy"), by)
        .join(extreme_share(both, by), by)
    )
