"""Pooling review scores into one verdict per film, for all films at once.

Films may be of any size: counts and sums combine in the map tasks, order
statistics come from bucketed running counts, and nothing gathers the reviews
of one film in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.config import DEPTHS, LABEL_NAMES, MIN_REVIEWS_PER_FILM, RULES, SEED
from reviewlytics.functions.stats import share_interval
from reviewlytics.operators.ranking import SCORE_DIGITS, rank_by_hash, rounded_score, running_totals
from reviewlytics.operators.sampling import k_per_group, one_per_group
from reviewlytics.runtime import arrow_batches, lookup, settle, ship_package

try:
    from _md5 import md5
except ImportError:
    from hashlib import md5

POSITIVE = 0.5
TRIM_PERCENT = 10
SMALLEST_TRIMMED = 5
#: Reviews, and scores that they pick among, in a row; picks of a row, which holds so many draws.
SLICE, CHUNK, PICKS = 1 << 15, 1 << 20, 1 << 21
#: Half of a window, in roots of the film's size: ten standard deviations. Scores are counted in units of their last digit.
WIDTH, UNITS = 3.0, 10**SCORE_DIGITS
#: Bytes of rows that a worker is handed at a time.
BATCH_BYTES = 8 * 1024 * 1024


def check_rule(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; choose from {', '.join(RULES)}")
    return rule


def group_scores(scored: DataFrame, film: str = "film_id") -> DataFrame:
    """Reviews that belong to a film: ``film, doc_id, score`` rows."""
    return scored.filter(F.col(film).isNotNull()).select(film, "doc_id", "score")


def moments(scored: DataFrame, by: list[str]) -> DataFrame:
    positive = F.col("score") >= F.lit(POSITIVE)
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_reviews"),
        F.count_if(positive).alias("n_positive"),
        F.avg(positive.cast("double")).alias("share_positive"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("polarisation"),
    )


def rule_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """All three rules in one pass: ``by..., majority, mean_probability, trimmed_mean``.

    The trimmed mean keeps scores between the 10% and the 90% quantile, both
    included. A score is kept exactly when its ranks reach the first whole
    rank at or above the lower quantile and the last at or below the upper one.
    """
    counted = scored.withColumns({"score": rounded_score(F.col("score")), "n": F.lit(1)})
    sums = running_totals(counted, by, "score", ["n"])
    n, total, before = F.col("n"), F.col("n_total"), F.col("n_before")
    lowest = F.ceil((total - 1) * TRIM_PERCENT / F.lit(100))
    highest = F.floor((total - 1) * (100 - TRIM_PERCENT) / F.lit(100))
    kept = (total < SMALLEST_TRIMMED) | ((before + n - 1 >= lowest) & (before <= highest))
    score = F.col("score")
    return sums.groupBy(*by).agg(
        (F.sum(F.when(score >= F.lit(POSITIVE), n).otherwise(0)) / F.sum(n)).alias("majority"),
        (F.sum(score * n) / F.sum(n)).alias("mean_probability"),
        (F.sum(F.when(kept, score * n)) / F.sum(F.when(kept, n))).alias("trimmed_mean"),
    )


def _scores_of(seed: str, name: str, draws: range, docs: list[bytes], scores: np.ndarray, n: int, base: int) -> Iterator[np.ndarray]:
    """What the reviews ``docs`` pick in each draw among those numbered from ``base``, whose scores are ``scores``, of ``n`` reviews."""
    for draw in draws:
        begun = md5(f"{seed}:{name}:{draw}".encode())

        def digest(doc: bytes, begun=begun) -> bytes:
            whole = begun.copy()
            whole.update(doc)
            return whole.digest()

        number = np.frombuffer(b"".join(map(digest, docs)), ">u4")[::4].astype(np.int64) % n - base
        if len(scores) < n:
            number = number[(number >= 0) & (number < len(scores))]
        yield scores.take(number)


def _ranks(n):
    """Ranks, from 0, of the lowest and the highest score that a trimmed mean keeps."""
    return -(-(n - 1) * TRIM_PERCENT // 100), (n - 1) * (100 - TRIM_PERCENT) // 100


def _rules_of(n: int, positive, total, kept, kept_n) -> dict[str, np.ndarray]:
    """The rules of some draws of ``n`` reviews from whole sums, so that no order of addition shows."""
    return dict(zip(RULES, (positive / n, total / UNITS / n, kept / UNITS / kept_n), strict=True))


def _drawn_whole(batches: Iterator[pa.RecordBatch], seed: str, film: str) -> Iterator[pa.RecordBatch]:
    """The rules of each draw of films that are in one row."""
    for batch in batches:
        for i, row in enumerate(batch.drop_columns(film).to_pylist()):
            n, draws = row["_n"], range(row["_first"], row["_end"])
            scores = np.array(row["_scores"], np.int64)
            drawn = np.sort(np.stack([*_scores_of(seed, row["_name"], draws, [d.encode() for d in row["_docs"]], scores, n, 0)]), axis=1)
            low, high = _ranks(n) if n >= SMALLEST_TRIMMED else (0, n - 1)
            kept = (drawn >= drawn[:, [low]]) & (drawn <= drawn[:, [high]])
            rules = _rules_of(n, (drawn >= POSITIVE * UNITS).sum(axis=1), drawn.sum(axis=1), (drawn * kept).sum(axis=1), kept.sum(axis=1))
            films = batch[film].take(pa.array(np.full(len(draws), i)))
            yield pa.RecordBatch.from_arrays([films, *map(pa.array, rules.values()), pa.array(np.zeros(len(draws), bool))], [film, *RULES, "_missed"])


_SUMS = ("positive", "total", "below", "mid", "mid_total")


def _drawn_parts(batches: Iterator[pa.RecordBatch], seed: str, film: str) -> Iterator[pa.RecordBatch]:
    """Sums of each draw over some reviews of a film that pick among some, with the scores in the windows one by one."""
    for batch in batches:
        for i, row in enumerate(batch.drop_columns(film).to_pylist()):
            draws, scores = range(row["_first"], row["_end"]), np.array(row["_scores"], np.int64)
            a, b, c, d = (row[f"_{x}"] for x in "abcd")
            sums, values, counts = [], [], []
            for drawn in _scores_of(seed, row["_name"], draws, [x.encode() for x in row["_docs"]], scores, row["_n"], row["_base"]):
                mid = (drawn > b) & (drawn < c)
                inside = drawn[(drawn >= a) & (drawn <= d) & ~mid]
                sums.append([int(x.sum()) for x in (drawn >= POSITIVE * UNITS, drawn, drawn < a, mid, drawn[mid])])
                value, count = np.unique(inside, return_counts=True)
                values.append(value)
                counts.append(count)
            at = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), pa.int64())) for x in (values, counts)]
            same = pa.array(np.full(len(draws), i))
            columns = [batch[x].take(same) for x in (film, "_first", "_n", "_b")]
            columns += [pa.array([*draws], pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*sums, strict=True)), *lists]
            yield pa.RecordBatch.from_arrays(columns, [film, "_first", "_n", "_b", "draw", *_SUMS, "values", "counts"])


def _pooled(film: str):
    """The rules of a film's draws from the parts of each; a draw is missed if a score that it is trimmed at is in no window."""
    def pool(parts: pd.DataFrame) -> pd.DataFrame:
        n, b = int(parts["_n"].iloc[0]), parts["_b"].iloc[0]
        draw = (parts["draw"] - parts["draw"].min()).to_numpy()
        draws = int(draw.max()) + 1
        sums = {x: np.bincount(draw, parts[x].to_numpy(float), draws) for x in _SUMS}
        own = np.repeat(draw, [len(x) for x in parts["values"]])
        value, count = (np.concatenate(parts[x].to_list()).astype(np.int64) for x in ("values", "counts"))
        order = np.lexsort((value, own))
        own, value, count = own[order], value[order], count[order]
        end = np.cumsum(count)
        inside = np.bincount(own, count, draws).astype(np.int64)
        # Scores of the same draw that are less: in the windows, below them, and between them.
        before = end - count - (np.cumsum(inside) - inside - sums["below"])[own] + np.where(value > b, sums["mid"][own], 0)
        edges, missed = [], np.zeros(draws, bool)
        for rank in _ranks(n) if n >= SMALLEST_TRIMMED else (0, n - 1):
            hit, edge = (before <= rank) & (before + count > rank), np.zeros(draws, np.int64)
            edge[own[hit]] = value[hit]
            missed |= np.bincount(own[hit], minlength=draws) == 0
            edges.append(edge)
        low, high = edges
        kept = (value >= low[own]) & (value <= high[own])
        across = (low <= b) & (high > b)
        kept_n = np.bincount(own, count * kept, draws) + across * sums["mid"]
        kept = np.bincount(own, (count * value * kept).astype(float), draws) + across * sums["mid_total"]
        return pd.DataFrame(_rules_of(n, sums["positive"], sums["total"], kept, np.maximum(kept_n, 1))).assign(
            **{film: parts[film].iloc[0], "_missed": missed}
        )[[film, *RULES, "_missed"]]

    return pool


def _windows(numbered: DataFrame, film: str, width: float | None) -> DataFrame:
    """``film, _a, _b, _c, _d``: scores from a to b, and from c to d, hold those that the trimmed means of draws begin and end at.

    The score at a rank of a draw is, among the film's own, some standard
    deviations (0.3 roots of the size at these ranks) from that rank: at most
    ``width`` roots of the size if reviews pick independently of each other.
    Without ``width`` all scores are in the first window.
    """
    totals = running_totals(numbered.withColumn("n", F.lit(1)), [film], "score", ["n"])
    n, before, unit = F.col("n_total"), F.col("n_before"), _unit(F.col("score"))
    room = n if width is None else F.ceil(F.sqrt(n.cast("double")) * F.lit(width)) + 10
    low, high = F.ceil((n - 1) * TRIM_PERCENT / F.lit(100)), F.floor((n - 1) * (100 - TRIM_PERCENT) / F.lit(100))
    at = [F.max(F.when(before <= F.greatest(x, F.lit(0)), unit)) for x in (low - room, low + room, high - room, high + room)]
    found = totals.groupBy(film).agg(*[x.alias(f"_{c}") for x, c in zip(at, "abcd", strict=True)])
    apart = F.col("_c") > F.col("_b")
    return settle(found.select(film, "_a", F.when(apart, F.col("_b")).otherwise(F.col("_d")).alias("_b"), F.when(apart, F.col("_c")).otherwise(F.col("_d")).alias("_c"), "_d"), "windows")


def _unit(score: Column) -> Column:
    """A score as a whole number of its last digit."""
    return F.round(score * F.lit(float(UNITS))).cast("bigint")


def _draws(numbered: DataFrame, film: str, n_boot: int, seed, windows: DataFrame | None) -> DataFrame:
    """``film``, the three rules and ``_missed`` of every draw.

    Every review casts one pick per draw: a hash chooses the number of a
    review of the same film. A row holds SLICE reviews, the scores of CHUNK
    that they may pick, and some draws, PICKS picks in all. Picks are looked
    up and pooled in their row; ``windows`` are given for films of several
    rows, of which only sums and the scores in the windows are shuffled.
    """
    place, doc = F.col("_number") - 1, F.col("doc_id").cast("string")
    n, name = F.first("_n").alias("_n"), F.col(film).cast("string").alias("_name")
    suffix = F.when(doc.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), doc))
    slices = numbered.groupBy(film, F.floor(place / SLICE).alias("_slice")).agg(n, F.collect_list(suffix).alias("_docs"))
    scores = F.sort_array(F.collect_list(F.struct("_number", _unit(F.col("score")).alias("score"))))["score"].alias("_scores")
    chunks = numbered.groupBy(film, F.floor(place / CHUNK).alias("_chunk")).agg(n, scores)
    step = F.greatest(F.lit(1), F.least(F.lit(n_boot), F.floor(F.lit(PICKS) / F.least("_n", F.lit(SLICE))))).cast("int")
    first = F.explode(F.sequence(F.lit(1), F.lit(n_boot), step)).alias("_first")
    ends = F.least(F.col("_first") + step, F.lit(n_boot + 1)).cast("int").alias("_end")
    chunks = chunks.select(film, first, (F.col("_chunk") * CHUNK).alias("_base"), "_scores")
    units = slices.select(film, "_n", "_docs", first).join(chunks.hint("merge"), [film, "_first"])
    shape = f"`{film}` {numbered.schema[film].dataType.simpleString()}"
    rules = f"{shape}, " + ", ".join(f"{r} double" for r in RULES) + ", _missed boolean"
    if windows is None:
        return units.select(film, name, "_n", "_first", ends, "_docs", "_scores").mapInArrow(partial(_drawn_whole, seed=str(seed), film=film), rules)
    units = lookup(units, windows, [film]).select(film, name, "_n", "_first", ends, "_docs", "_base", "_scores", *[f"_{x}" for x in "abcd"])
    parts = units.mapInArrow(
        partial(_drawn_parts, seed=str(seed), film=film),
        f"{shape}, _first int, _n bigint, _b bigint, draw int, " + ", ".join(f"{x} bigint" for x in _SUMS) + ", values array<bigint>, counts array<bigint>",
    )
    return parts.groupBy(film, "_first").applyInPandas(_pooled(film), rules)


def bootstrap_intervals(
    scored: DataFrame, film: str = "film_id", n_boot: int = 2_000, seed=SEED, in_row: int | None = None
) -> DataFrame:
    """95% percentile intervals of all rules: ``film, <rule>_low, <rule>_high``.

    Every film is drawn review by review. Those of at most ``in_row`` reviews
    are pooled in one row, larger ones in parts whose sums are added up: the
    same picks and the same results, and no task holds a large film's reviews.
    """
    ship_package(scored.sparkSession)
    bound = min(SLICE, CHUNK) if in_row is None else in_row
    rows = scored.filter(F.col(film).isNotNull() & F.col("score").isNotNull()).select(film, "doc_id", rounded_score(F.col("score")).alias("score"))
    numbered = settle(rank_by_hash(rows, [film], "doc_id", seed, "_number", "_n"), "numbered")
    small, large = numbered.filter(F.col("_n") <= bound), numbered.filter(F.col("_n") > bound)
    ends = F.array(F.lit(0.025), F.lit(0.975))

    def ranged(draws: DataFrame, name: str) -> DataFrame:
        with arrow_batches(scored.sparkSession, BATCH_BYTES):
            return settle(draws.groupBy(film).agg(*[F.percentile(rule, ends).alias(rule) for rule in RULES], F.max("_missed").alias("_missed")), name)

    wide = ranged(_draws(small, film, n_boot, seed, None), "ranges")
    if not large.isEmpty():
        apart = ranged(_draws(large, film, n_boot, seed, _windows(large, film, WIDTH)), "large-ranges")
        # Picks of repeated keys go together, which may lead a draw out of its windows.
        missed = apart.filter("_missed").select(film)
        if not missed.isEmpty():
            again = lookup(large, missed, [film])
            apart = apart.filter("not _missed").unionByName(ranged(_draws(again, film, n_boot, seed, _windows(again, film, None)), "missed-ranges"))
        wide = wide.unionByName(apart)
    return wide.select(film, *[
        F.get(rule, i).alias(f"{rule}_{end}") for rule in RULES for i, end in enumerate(("low", "high"))
    ])


def _finish(df: DataFrame, film: str, rule: str | Column, score: Column, low: Column, high: Column) -> DataFrame:
    positive = score >= F.lit(POSITIVE)
    outside = ~((low <= F.lit(POSITIVE)) & (high >= F.lit(POSITIVE)))
    name = F.lit(rule) if isinstance(rule, str) else rule
    return df.select(
        film, name.alias("method"), F.col("n_reviews"),
        F.when(positive, LABEL_NAMES[1]).otherwise(LABEL_NAMES[0]).alias("sentiment"),
        score.alias("score"), low.alias("ci_low"), high.alias("ci_high"),
        "share_positive", "polarisation", outside.alias("decisive"),
    )


def film_verdicts(
    scored: DataFrame, method: str = "majority", film: str = "film_id",
    n_boot: int = 2_000, seed=SEED, min_reviews: int = 1,
) -> DataFrame:
    """One verdict per film.

    Majority votes need no resampling: their interval is binomial and comes
    from two counts, so the whole verdict is a single aggregation. The other
    rules resample.
    """
    check_rule(method)
    rows = group_scores(scored, film)
    films = moments(rows, [film]).filter(F.col("n_reviews") >= min_reviews)
    if method == "majority":
        ranged = films.withColumn("_ci", share_interval(F.col("n_reviews"), F.col("n_positive")))
        return _finish(ranged, film, method, F.col("share_positive"), F.col("_ci.low"), F.col("_ci.high"))
    points = rule_scores(rows, [film]).select(film, F.col(method).alias("_score"))
    ranges = bootstrap_intervals(rows, film, n_boot, seed)
    return _finish(
        films.join(points, film).join(ranges, film), film, method, F.col("_score"),
        F.col(f"{method}_low"), F.col(f"{method}_high"),
    )


def compare_rules(
    scored: DataFrame, film: str = "film_id", n_boot: int = 2_000, seed=SEED
) -> DataFrame:
    """Every rule on every film, one row each; the resamples are shared."""
    rows = group_scores(scored, film)
    wide = (
        moments(rows, [film]).join(rule_scores(rows, [film]), film)
        .join(bootstrap_intervals(rows, film, n_boot, seed), film)
    )
    stacked = wide.select(film, "n_reviews", "share_positive", "polarisation", F.inline(F.array(*[
        F.struct(
            F.lit(rule).alias("_rule"), F.col(rule).alias("_score"),
            F.col(f"{rule}_low").alias("_low"), F.col(f"{rule}_high").alias("_high"),
        )
        for rule in RULES
    ])))
    return _finish(stacked, film, F.col("_rule"), F.col("_score"), F.col("_low"), F.col("_high"))


def summary_line(verdicts: DataFrame, film: str = "film_id") -> DataFrame:
    """A readable sentence per verdict, hedged where it is not decisive."""
    hedge = F.when(F.col("decisive"), "").otherwise("  (not statistically decisive)")
    text = F.format_string(
        "%s: %s  score=%.3f CI95=[%.3f, %.3f]  n=%d  positive_share=%.1f%%  polarisation=%.3f%s",
        film, F.upper("sentiment"), "score", "ci_low", "ci_high", "n_reviews",
        F.col("share_positive") * F.lit(100.0), "polarisation", hedge,
    )
    return verdicts.select(film, "method", text.alias("summary"))


def film_gold(scored: DataFrame, film: str = "film_id") -> DataFrame:
    """Gold polarity of each film: the majority of its labels, ties positive."""
    label = F.col("label").cast("double")
    return scored.filter(F.col(film).isNotNull()).groupBy(film).agg(
        F.count("*").alias("n_reviews"), F.avg(label).alias("gold_share"),
        (F.avg(label) >= F.lit(0.5)).cast("int").alias("gold"),
        (F.min("label") != F.max("label")).alias("mixed"),
    )


def eligible_films(scored: DataFrame, film: str = "film_id", min_reviews: int = MIN_REVIEWS_PER_FILM) -> DataFrame:
    return film_gold(scored, film).filter(F.col("n_reviews") >= min_reviews)


def evaluate_rules(
    scored: DataFrame, film: str = "film_id", n_boot: int = 400, seed=SEED,
    min_reviews: int = MIN_REVIEWS_PER_FILM,
) -> DataFrame:
    """Accuracy and decisive share of each rule, on all and on mixed films."""
    gold = eligible_films(scored, film, min_reviews).select(film, "gold", "mixed")
    rows = group_scores(scored, film)
    single = one_per_group(rows, [film], "score", "doc_id", seed).select(
        film, F.lit("single review (baseline)").alias("rule"),
        (F.col("score") >= F.lit(POSITIVE)).cast("int").alias("pred"), F.lit(None).cast("double").alias("sure"),
    )
    rules = compare_rules(scored, film, n_boot, seed).select(
        film, F.col("method").alias("rule"), (F.col("sentiment") == LABEL_NAMES[1]).cast("int").alias("pred"),
        F.col("decisive").cast("double").alias("sure"),
    )
    judged = single.unionByName(rules).join(gold, film)
    subset = F.explode(F.when(
        F.col("mixed"), F.array(F.lit("all films"), F.lit("mixed-polarity films"))
    ).otherwise(F.array(F.lit("all films")))).alias("subset")
    return judged.select("*", subset).groupBy("subset", "rule").agg(
        F.count("*").alias("n_films"),
        F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"),
        (F.avg("sure") * F.lit(100.0)).alias("decisive_pct"),
    )


def pooling_depth(
    scored: DataFrame, film: str = "film_id", depths: tuple[int, ...] = DEPTHS, seed=SEED,
    min_reviews: int = MIN_REVIEWS_PER_FILM,
) -> DataFrame:
    """Accuracy on mixed films when k of a film's reviews are pooled."""
    mixed = eligible_films(scored, film, min_reviews).filter("mixed").select(film, "gold", "n_reviews")
    drawn = k_per_group(group_scores(scored, film), [film], depths, "doc_id", seed)
    pooled = rule_scores(drawn, [film, "k"]).join(mixed, film)
    right = ((F.col("trimmed_mean") >= F.lit(POSITIVE)).cast("int") == F.col("gold")).cast("double")
    enough = F.col("n_reviews") >= F.col("k")
    return pooled.groupBy(F.col("k").alias("reviews_pooled")).agg(
        F.count_if(enough).alias("n_films_with_enough"),
        F.avg(right).alias("accuracy_all_films"),
        F.avg(F.when(enough, right)).alias("accuracy_films_with_enough"),
    )


def scenario_films(scored: DataFrame, film: str = "film_id", min_reviews: int = 12) -> DataFrame:
    """The biggest clearly liked film and the most evenly divided one."""
    able = eligible_films(scored, film, min_reviews).withColumn(
        "balance", F.round(F.abs(F.col("gold_share") - F.lit(0.5)), 9)
    )
    clear = able.filter(F.round("gold_share", 9) >= F.lit(0.9)).orderBy(F.desc("n_reviews"), film).limit(1)
    split = able.orderBy("balance", F.desc("n_reviews"), film).limit(1)
    cols = [film, "n_reviews", "gold_share", "gold"]
    return clear.select(F.lit("consistent reception").alias("scenario"), *cols).unionByName(
        split.select(F.lit("divided audience").alias("scenario"), *cols)
    )


def scenario_records(
    scored: DataFrame, film: str = "film_id", min_reviews: int = 12, n_boot: int = 2_000, seed=SEED
) -> DataFrame:
    """One wide row per scenario film: gold share and every rule's verdict.

    Only the two films' reviews are judged; the semi-join reaches the scan of
    the scored table.
    """
    picked = scenario_films(scored, film, min_reviews)
    rows = scored.join(picked.select(film).distinct(), film, "left_semi")
    wide = compare_rules(rows, film, n_boot, seed).groupBy(film).pivot("method", list(RULES)).agg(
        F.first("sentiment").alias("sentiment"), F.first("score").alias("score"),
        F.first("ci_low").alias("ci_low"), F.first("ci_high").alias("ci_high"),
        F.first("decisive").alias("decisive"),
    )
    return picked.join(wide, film).select(
        "scenario", film, "n_reviews", "gold_share",
        F.when(F.col("gold") == 1, LABEL_NAMES[1]).otherwise(LABEL_NAMES[0]).alias("gold_sentiment"),
        *[f"{rule}_sentiment" for rule in RULES], *[f"{rule}_score" for rule in RULES],
        "trimmed_mean_ci_low", "trimmed_mean_ci_high", "trimmed_mean_decisive",
    )
