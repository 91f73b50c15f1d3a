"""Evaluation, film verdicts, slices and corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlytics.config import RULES, SEED
from reviewlytics.functions.text import probe_flags, word_count
from reviewlytics.operators import evaluate, reports, sampling, verdict
from reviewlytics.operators.reports import LENGTH_EDGES
from reviewlytics.plans import sql as s
from reviewlytics.plans.base import Registry, documents, out_of_fold, review_tokens, reviews, scored_texts
from reviewlytics.plans.model_queries import CONVERSATION_TURNS, conversation_scores
from reviewlytics.runtime import settle, settled_once, table

registry = Registry()
add = registry.add
BY = ["corpus"]
OOF = s.with_(s.OUT_OF_FOLD)


def oof(*ctes: str) -> str:
    return s.with_(s.OUT_OF_FOLD, *ctes)


# -- evaluation ------------------------------------------------------------------- #
CELLS = """cells AS MATERIALIZED (
  SELECT corpus, CAST(count(*) FILTER (label = 0 AND pred = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (label = 0 AND pred = 1) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (label = 1 AND pred = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (label = 1 AND pred = 1) AS DOUBLE) AS tp
  FROM scored GROUP BY corpus)"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / ({b}) END"


F1P, F1N = ratio("2 * tp", "(2 * tp + fp + fn)"), ratio("2 * tn", "(2 * tn + fp + fn)")
MACRO = f"""metrics AS MATERIALIZED (
  SELECT corpus, CAST(tn + fp + fn + tp AS BIGINT) AS n, {ratio('(tp + tn)', '(tn + fp + fn + tp)')} AS accuracy,
    (({ratio('tp', '(tp + fp)')}) + ({ratio('tn', '(tn + fn)')})) / 2 AS precision_macro,
    (({ratio('tp', '(tp + fn)')}) + ({ratio('tn', '(tn + fp)')})) / 2 AS recall_macro,
    (({F1P}) + ({F1N})) / 2 AS f1_macro, {F1P} AS f1_positive, {F1N} AS f1_negative,
    CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM cells)"""
MACRO_COLUMNS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_positive", "f1_negative")
# Brute force over all pairs of a positive and a negative review.
AUC = """auc AS MATERIALIZED (
  SELECT p.corpus, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) AS roc_auc
  FROM scored p JOIN scored q ON p.corpus = q.corpus AND p.label = 1 AND q.label = 0 GROUP BY p.corpus)"""
AP = """steps AS MATERIALIZED (
  SELECT corpus, score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY corpus, score),
upto AS MATERIALIZED (
  SELECT corpus, score, pos, CAST(sum(pos) OVER w AS DOUBLE) AS hits, CAST(sum(n) OVER w AS DOUBLE) AS taken,
    CAST(sum(pos) OVER (PARTITION BY corpus) AS DOUBLE) AS all_pos, CAST(sum(n) OVER (PARTITION BY corpus) AS DOUBLE) AS all_n
  FROM steps WINDOW w AS (PARTITION BY corpus ORDER BY score DESC)),
ap AS MATERIALIZED (SELECT corpus, sum(pos * hits / taken) / max(all_pos) AS average_precision FROM upto GROUP BY corpus)"""
HITS = "hits_n AS MATERIALIZED (SELECT corpus, count(*) AS n, count(*) FILTER (pred = label) AS hits FROM scored GROUP BY corpus)"
ACC_CI = HITS + ",\n" + s.share_interval("acc_ci", "hits_n", "corpus")


@add("accuracy", oof() + s.rounded("SELECT corpus, count(*) AS n, avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM scored GROUP BY corpus", "accuracy"))
def _(spark, folder):
    return evaluate.class_metrics(out_of_fold(spark, folder), BY).select("corpus", "n", "accuracy")


@add("macro_metrics", oof(CELLS, MACRO) + s.rounded("SELECT * FROM metrics", *MACRO_COLUMNS))
def _(spark, folder):
    return evaluate.class_metrics(out_of_fold(spark, folder), BY)


@add("confusion_matrix", oof() + """
    SELECT corpus, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
      count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM scored GROUP BY corpus""")
def _(spark, folder):
    return evaluate.confusion(out_of_fold(spark, folder), BY)


@add("normalised_confusion_matrix", oof() + s.rounded("""
    SELECT corpus, label, count(*) AS n, avg(CAST(pred = 0 AS DOUBLE)) AS share_pred_0, avg(CAST(pred = 1 AS DOUBLE)) AS share_pred_1
    FROM scored GROUP BY corpus, label""", "share_pred_0", "share_pred_1"))
def _(spark, folder):
    return evaluate.normalised_confusion(out_of_fold(spark, folder), BY)


@add("roc_auc", oof(AUC) + s.rounded("SELECT corpus, roc_auc FROM (SELECT DISTINCT corpus FROM scored) LEFT JOIN auc USING (corpus)", "roc_auc"))
def _(spark, folder):
    return evaluate.roc_auc(out_of_fold(spark, folder), BY)


@add("average_precision", oof(AP) + s.rounded("SELECT corpus, average_precision FROM ap", "average_precision"))
def _(spark, folder):
    return evaluate.average_precision(out_of_fold(spark, folder), BY)


@add("roc_curve", oof(AP) + """SELECT corpus, score AS threshold,
      round(CASE WHEN all_n = all_pos THEN 0.0 ELSE (taken - hits) / (all_n - all_pos) END, 9) AS fpr,
      round(CASE WHEN all_pos = 0 THEN 0.0 ELSE hits / all_pos END, 9) AS tpr FROM upto""", digits=9)
def _(spark, folder):
    return evaluate.roc_curve(out_of_fold(spark, folder), BY)


@add("accuracy_interval", oof(ACC_CI) + s.rounded(
    "SELECT corpus, n, CAST(hits AS DOUBLE) / n AS accuracy, ci_low, ci_high FROM acc_ci", "accuracy", "ci_low", "ci_high"))
def _(spark, folder):
    return evaluate.accuracy_interval(out_of_fold(spark, folder), BY)


@add("metric_record", oof(CELLS, MACRO, AUC, AP, ACC_CI) + s.rounded("""
    SELECT metrics.*, roc_auc, average_precision, ci_low, ci_high FROM metrics LEFT JOIN auc USING (corpus)
    LEFT JOIN ap USING (corpus) JOIN (SELECT corpus, ci_low, ci_high FROM acc_ci) USING (corpus)""",
    *MACRO_COLUMNS, "roc_auc", "average_precision", "ci_low", "ci_high"))
def _(spark, folder):
    return evaluate.compute_metrics(out_of_fold(spark, folder), BY)


@add("class_report", oof(CELLS, f"""per_class AS MATERIALIZED (
  SELECT corpus, 'negative' AS class, {ratio('tn', '(tn + fn)')} AS precision, {ratio('tn', '(tn + fp)')} AS recall, {F1N} AS f1, tn + fp AS support FROM cells
  UNION ALL SELECT corpus, 'positive', {ratio('tp', '(tp + fp)')}, {ratio('tp', '(tp + fn)')}, {F1P}, tp + fn FROM cells)""") + s.rounded("""
    SELECT corpus, class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM (SELECT * FROM per_class
    UNION ALL SELECT corpus, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class GROUP BY corpus
    UNION ALL SELECT corpus, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support) FROM per_class GROUP BY corpus)""", "precision", "recall", "f1"))
def _(spark, folder):
    return evaluate.class_report(out_of_fold(spark, folder), BY)


def _edge_bin(value: str, edges, right_closed: bool) -> str:
    arms = []
    for i in range(len(edges) - 1):
        low, high = f"CAST({edges[i]!r} AS DOUBLE)", f"CAST({edges[i + 1]!r} AS DOUBLE)"
        test = f"{value} > {low} AND {value} <= {high}" if right_closed else f"{value} >= {low} AND {value} < {high}"
        arms.append(f"WHEN {test} THEN {i}")
    return "CASE " + " ".join(arms) + " END"


@add("calibration_error", oof("""sure AS MATERIALIZED (
  SELECT corpus, CASE WHEN score >= 0.5 THEN score ELSE CAST(1.0 AS DOUBLE) - score END AS c, CAST(pred = label AS DOUBLE) AS ok FROM scored)""",
  f"bins AS (SELECT corpus, {_edge_bin('c', evaluate.CONFIDENCE_EDGES, True)} AS bin, count(*) AS n, avg(ok) AS acc, avg(c) AS conf FROM sure GROUP BY ALL)") + s.rounded(
    "SELECT corpus, coalesce(sum(n * abs(acc - conf)) FILTER (bin IS NOT NULL), 0.0) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY corpus", "ece"))
def _(spark, folder):
    return evaluate.expected_calibration_error(out_of_fold(spark, folder), BY)


@add("reliability_curve", oof(f"bins AS (SELECT *, {_edge_bin('score', evaluate.SCORE_EDGES, False)} AS tenth FROM scored)") + s.rounded("""
    SELECT corpus, tenth AS bin, avg(score) AS mean_score, avg(CAST(label AS DOUBLE)) AS positive_rate, count(*) AS n
    FROM bins WHERE tenth IS NOT NULL GROUP BY corpus, tenth HAVING count(*) >= 30""", "mean_score", "positive_rate"))
def _(spark, folder):
    return evaluate.reliability_curve(out_of_fold(spark, folder), BY)


@add("extreme_scores", oof() + s.rounded("""
    SELECT corpus, 100.0 * avg(CAST(score > 0.99 OR score < 0.01 AS DOUBLE)) AS share_beyond_99_pct FROM scored GROUP BY corpus""", "share_beyond_99_pct"))
def _(spark, folder):
    return evaluate.extreme_share(out_of_fold(spark, folder), BY)


# -- film verdicts ------------------------------------------------------------------- #
#: Draws of an interval, and of the rules' evaluation over many subsamples.
N_BOOT, N_BOOT_EVALUATION = 2_000, 400
VERDICT = ("score", "ci_low", "ci_high", "share_positive", "polarisation")
VERDICT_COLUMNS = "film_id, method, n_reviews, sentiment, score, ci_low, ci_high, share_positive, polarisation, decisive"
ALL_RULES = oof(s.compare_rules("scored", N_BOOT))


@add("film_verdict_majority", oof(s.majority_verdicts("scored")) + s.rounded(f"SELECT {VERDICT_COLUMNS} FROM majority", *VERDICT))
def _(spark, folder):
    return verdict.film_verdicts(out_of_fold(spark, folder))


@add("film_verdict_mean", ALL_RULES + s.rounded(f"SELECT {VERDICT_COLUMNS} FROM verdicts WHERE method = 'mean_probability'", *VERDICT))
def _(spark, folder):
    return verdict.film_verdicts(out_of_fold(spark, folder), "mean_probability", n_boot=N_BOOT)


@add("film_verdict_trimmed", ALL_RULES + s.rounded(f"SELECT {VERDICT_COLUMNS} FROM verdicts WHERE method = 'trimmed_mean'", *VERDICT))
def _(spark, folder):
    return verdict.film_verdicts(out_of_fold(spark, folder), "trimmed_mean", n_boot=N_BOOT)


def all_verdicts(spark, folder):
    return settled_once(spark, folder, "all-verdicts", lambda: verdict.compare_rules(out_of_fold(spark, folder), n_boot=N_BOOT))


@add("film_verdict_all_rules", ALL_RULES + s.rounded(f"SELECT {VERDICT_COLUMNS} FROM verdicts", *VERDICT))
def _(spark, folder):
    return all_verdicts(spark, folder)


@add("film_verdict_summary", oof(s.majority_verdicts("scored")) + """
    SELECT film_id, method, printf('%s: %s  score=%.3f CI95=[%.3f, %.3f]  n=%d  positive_share=%.1f%%  polarisation=%.3f%s', film_id, upper(sentiment),
      score, ci_low, ci_high, n_reviews, share_positive * 100.0, polarisation, CASE WHEN decisive THEN '' ELSE '  (not statistically decisive)' END) AS summary FROM majority""")
def _(spark, folder):
    return verdict.summary_line(verdict.film_verdicts(out_of_fold(spark, folder)))


@add("conversation_verdicts", s.with_(s.FULL_MODEL, CONVERSATION_TURNS, s.scored("turn_scores", "nb", "turns", "conv_id"),
                                      s.majority_verdicts("turn_scores", "conv_id")) + s.rounded(
    f"SELECT {VERDICT_COLUMNS.replace('film_id', 'conv_id')} FROM majority", *VERDICT))
def _(spark, folder):
    return verdict.film_verdicts(conversation_scores(spark, folder), film="conv_id")


@add("film_scores", oof() + "SELECT film_id, doc_id, score FROM scored WHERE film_id IS NOT NULL", digits=9)
def _(spark, folder):
    return verdict.group_scores(out_of_fold(spark, folder))


GOLD = """gold AS MATERIALIZED (
  SELECT film_id, count(*) AS n_reviews, avg(CAST(label AS DOUBLE)) AS gold_share, CAST(avg(CAST(label AS DOUBLE)) >= 0.5 AS INTEGER) AS gold,
    min(label) <> max(label) AS mixed FROM scored WHERE film_id IS NOT NULL GROUP BY film_id)"""


@add("film_gold", oof(GOLD) + s.rounded("SELECT * FROM gold", "gold_share"))
def _(spark, folder):
    return verdict.film_gold(out_of_fold(spark, folder))


@add("films_with_enough_reviews", oof(GOLD) + s.rounded("SELECT film_id, n_reviews, gold_share FROM gold WHERE n_reviews >= 20", "gold_share"))
def _(spark, folder):
    return verdict.eligible_films(out_of_fold(spark, folder), min_reviews=20).select("film_id", "n_reviews", "gold_share")


@add("mixed_films", oof(GOLD) + "SELECT film_id, n_reviews FROM gold WHERE mixed")
def _(spark, folder):
    return verdict.film_gold(out_of_fold(spark, folder)).filter("mixed").select("film_id", "n_reviews")


@add("one_review_per_film", oof() + f"""
    SELECT film_id, arg_min(score, {s.md5(SEED, 'doc_id')}) AS score FROM scored GROUP BY film_id""", digits=9)
def _(spark, folder):
    return sampling.one_per_group(out_of_fold(spark, folder), ["film_id"], "score")


DEPTHS = "(1), (2), (3), (5), (8), (12), (20), (30)"
DEPTH = f"""depth_rows AS MATERIALIZED (
  SELECT film_id, doc_id, score, k FROM (SELECT film_id, doc_id, score, row_number() OVER (
    PARTITION BY film_id ORDER BY {s.md5(SEED, 'doc_id')}, doc_id) AS r FROM scored), (VALUES {DEPTHS}) d(k) WHERE r <= k)"""


@add("reviews_by_depth", oof(DEPTH) + "SELECT film_id, doc_id, score, k FROM depth_rows", digits=9)
def _(spark, folder):
    return sampling.k_per_group(verdict.group_scores(out_of_fold(spark, folder)), ["film_id"], verdict.DEPTHS)


@add("pooling_depth", oof(GOLD, DEPTH, s.rules("depth_rules", "depth_rows", "film_id, k")) + s.rounded("""
    SELECT k AS reviews_pooled, count(*) FILTER (n_reviews >= k) AS n_films_with_enough,
      avg(CAST(CAST(trimmed_mean >= 0.5 AS INTEGER) = gold AS DOUBLE)) AS accuracy_all_films,
      avg(CAST(CAST(trimmed_mean >= 0.5 AS INTEGER) = gold AS DOUBLE)) FILTER (n_reviews >= k) AS accuracy_films_with_enough
    FROM depth_rules JOIN gold USING (film_id) WHERE mixed AND n_reviews >= 5 GROUP BY k""", "accuracy_all_films", "accuracy_films_with_enough"))
def _(spark, folder):
    return verdict.pooling_depth(out_of_fold(spark, folder))


@add("film_rule_evaluation", oof(s.compare_rules("scored", N_BOOT_EVALUATION)).rstrip() + ",\n" + GOLD + f""",
judged AS (SELECT film_id, method AS rule, CAST(sentiment = 'positive' AS INTEGER) AS pred, CAST(decisive AS DOUBLE) AS sure FROM verdicts
  UNION ALL SELECT film_id, 'single review (baseline)', CAST(arg_min(score, {s.md5(SEED, 'doc_id')}) >= 0.5 AS INTEGER), NULL FROM scored GROUP BY film_id),
subsets AS (SELECT 'all films' AS subset, * FROM judged JOIN gold USING (film_id) WHERE n_reviews >= 5
  UNION ALL SELECT 'mixed-polarity films', * FROM judged JOIN gold USING (film_id) WHERE n_reviews >= 5 AND mixed)""" + s.rounded("""
    SELECT subset, rule, count(*) AS n_films, avg(CAST(pred = gold AS DOUBLE)) AS accuracy, avg(sure) * 100.0 AS decisive_pct
    FROM subsets GROUP BY subset, rule""", "accuracy", "decisive_pct"))
def _(spark, folder):
    return verdict.evaluate_rules(out_of_fold(spark, folder), n_boot=N_BOOT_EVALUATION)


SCENARIOS = f"""{GOLD},
scenarios AS MATERIALIZED (
  (SELECT 'consistent reception' AS scenario, film_id, n_reviews, gold_share, gold FROM gold WHERE n_reviews >= 12 AND round(gold_share, 9) >= 0.9
    ORDER BY n_reviews DESC, film_id LIMIT 1)
  UNION ALL (SELECT 'divided audience', film_id, n_reviews, gold_share, gold FROM gold WHERE n_reviews >= 12
    ORDER BY round(abs(gold_share - 0.5), 9), n_reviews DESC, film_id LIMIT 1))"""


@add("scenario_films", oof(SCENARIOS) + s.rounded("SELECT * FROM scenarios", "gold_share"))
def _(spark, folder):
    return verdict.scenario_films(out_of_fold(spark, folder))


def _wide(column: str) -> str:
    return ", ".join(f"max({column}) FILTER (method = '{r}') AS {r}_{column}" for r in RULES)


@add("scenario_records", ALL_RULES.rstrip() + ",\n" + SCENARIOS + s.rounded(f"""
    SELECT scenario, film_id, max(sc.n_reviews) AS n_reviews, max(gold_share) AS gold_share,
      CASE WHEN max(gold) = 1 THEN 'positive' ELSE 'negative' END AS gold_sentiment, {_wide('sentiment')}, {_wide('score')},
      max(ci_low) FILTER (method = 'trimmed_mean') AS trimmed_mean_ci_low, max(ci_high) FILTER (method = 'trimmed_mean') AS trimmed_mean_ci_high,
      bool_or(decisive) FILTER (method = 'trimmed_mean') AS trimmed_mean_decisive
    FROM scenarios sc JOIN verdicts USING (film_id) GROUP BY scenario, film_id""", "gold_share", *[f"{r}_score" for r in RULES],
    "trimmed_mean_ci_low", "trimmed_mean_ci_high"))
def _(spark, folder):
    return verdict.scenario_records(out_of_fold(spark, folder), n_boot=N_BOOT)


# -- slices of the scored table ------------------------------------------------------------ #
TEXTS = f"texts AS MATERIALIZED (SELECT s.*, text, {s.word_count('text')} AS words FROM scored s JOIN documents USING (doc_id))"
OK = "CAST(pred = label AS DOUBLE)"


@add("accuracy_by_language", oof() + s.rounded(f"""
    SELECT corpus, count(*) AS n, avg({OK}) AS accuracy, avg(score) AS mean_score, avg(CAST(label AS DOUBLE)) AS positive_rate
    FROM scored GROUP BY corpus""", "accuracy", "mean_score", "positive_rate"))
def _(spark, folder):
    return reports.by_slice(out_of_fold(spark, folder), "corpus")


@add("accuracy_by_rating", oof(TEXTS) + s.rounded(f"""
    SELECT CAST(least(10, 1 + length(text) // 500) AS INTEGER) AS star_rating, CASE WHEN min(label) = 1 THEN 'positive' ELSE 'negative' END AS gold_label,
      count(*) AS n, avg({OK}) AS accuracy, avg(score) AS mean_model_score FROM texts GROUP BY 1""", "accuracy", "mean_model_score"))
def _(spark, folder):
    """The given tables have no stars; ten classes of length stand for them."""
    stars = F.least(F.lit(10), F.lit(1) + F.floor(F.length("text") / F.lit(500)).cast("int"))
    return reports.by_rating(scored_texts(spark, folder).withColumn("rating", stars))


@add("accuracy_by_length", oof(TEXTS, """edges AS (
  SELECT quantile_cont(words, 0.2) AS a, quantile_cont(words, 0.4) AS b, quantile_cont(words, 0.6) AS c, quantile_cont(words, 0.8) AS d FROM texts)""") + s.rounded(f"""
    SELECT CASE WHEN words <= a THEN 'Q1' WHEN words <= b THEN 'Q2' WHEN words <= c THEN 'Q3' WHEN words <= d THEN 'Q4' ELSE 'Q5' END AS length_bin,
      CAST(min(words) AS INTEGER) AS min_words, CAST(max(words) AS INTEGER) AS max_words, quantile_cont(words, 0.5) AS median_words, count(*) AS n, avg({OK}) AS accuracy
    FROM texts, edges GROUP BY 1""", "median_words", "accuracy"))
def _(spark, folder):
    sized = documents(spark, folder).select("doc_id", word_count(F.col("text")).alias("words"))
    return reports.by_length(settle(out_of_fold(spark, folder).join(sized, "doc_id"), "sized"))


def _construction_arm(name: str, flag: str) -> str:
    return f"SELECT '{name}' AS construction, {flag} AS present, {OK} AS ok FROM texts"


def _construction_sql(flags: dict[str, str]) -> str:
    return oof(TEXTS, "stacked AS (" + " UNION ALL ".join(_construction_arm(n, f) for n, f in flags.items()) + ")") + s.rounded("""
    SELECT *, (accuracy_present - accuracy_absent) * 100.0 AS delta_pp FROM (
      SELECT construction, avg(CAST(present AS DOUBLE)) * 100.0 AS share_pct, avg(ok) FILTER (present) AS accuracy_present,
        avg(ok) FILTER (NOT present) AS accuracy_absent, avg(ok) AS overall_accuracy FROM stacked GROUP BY construction)""",
        "share_pct", "accuracy_present", "accuracy_absent", "overall_accuracy", "delta_pp")


@add("accuracy_by_construction", _construction_sql(s.PROBE_FLAGS))
def _(spark, folder):
    flags = documents(spark, folder).select("doc_id", *probe_flags(F.col("text")))
    return reports.by_construction(out_of_fold(spark, folder).join(flags, "doc_id"))


OWN_PROBES = (("restriction", r"\b(only|just|solo|nur|seulement)\b"), ("question", r"\?"), ("plural_article", r"\b(les|los|las|die)\b"))


@add("accuracy_by_own_construction", _construction_sql({n: s.probe(p) for n, p in OWN_PROBES}))
def _(spark, folder):
    return reports.by_construction(scored_texts(spark, folder), OWN_PROBES)


@add("confident_errors", oof(TEXTS) + """
    SELECT doc_id, film_id, label, pred, score, round(abs(score - 0.5) * 2.0, 9) AS confidence, substr(text, 1, 400) AS text
    FROM texts WHERE pred <> label ORDER BY confidence DESC, doc_id LIMIT 12""", digits=9)
def _(spark, folder):
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return reports.confident_errors(out_of_fold(spark, folder), texts, keep=("film_id",))


# -- corpora ------------------------------------------------------------------------------ #
STATS = ("positive_pct", "median_words", "mean_words", "p90_words", "median_chars")


def _stats_sql(source: str, label: bool) -> str:
    positive = "avg(CAST(label AS DOUBLE)) * 100.0 AS positive_pct," if label else ""
    return f"""SELECT corpus, count(*) AS documents, {positive} quantile_cont(words, 0.5) AS median_words, avg(words) AS mean_words,
      quantile_cont(words, 0.9) AS p90_words, CAST(max(words) AS INTEGER) AS max_words, quantile_cont(chars, 0.5) AS median_chars
      FROM (SELECT *, {s.word_count('text')} AS words, length(text) AS chars FROM {source}) GROUP BY corpus"""


@add("corpus_statistics", s.with_(s.REVIEWS) + s.rounded(_stats_sql("reviews", True), *STATS))
def _(spark, folder):
    return reports.corpus_statistics(reviews(spark, folder))


BY_LANG = "by_lang AS MATERIALIZED (SELECT doc_id, text, lang AS corpus FROM documents)"


def by_lang(spark, folder):
    return documents(spark, folder).select("doc_id", "text", F.col("lang").alias("corpus"))


@add("document_statistics", s.with_(BY_LANG) + s.rounded(_stats_sql("by_lang", False), *STATS[1:]))
def _(spark, folder):
    return reports.corpus_statistics(by_lang(spark, folder), label=None)


CORPORA = f"""corpora AS MATERIALIZED (
  SELECT text, lang AS corpus FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark),
corpus_words AS MATERIALIZED (
  SELECT corpus, word, count(*) AS n FROM (SELECT corpus, unnest(string_split({s.clean('text')}, ' ')) AS word FROM corpora)
  WHERE word <> '' GROUP BY corpus, word)"""


def corpus_words(spark, folder):
    def build():
        both = by_lang(spark, folder).select("text", "corpus").unionByName(
            table(spark, folder, "benchmark").select("text", F.lit("benchmark").alias("corpus"))
        )
        return reports.corpus_words(both)

    return settled_once(spark, folder, "corpus-words", build)


@add("corpus_word_counts", s.with_(CORPORA) + "SELECT corpus, word, n FROM corpus_words")
def _(spark, folder):
    return corpus_words(spark, folder)


@add("vocabulary_size", s.with_(CORPORA) + s.rounded("""
    SELECT corpus, count(*) AS vocab, avg(CAST(n = 1 AS DOUBLE)) * 100.0 AS hapax_pct FROM corpus_words GROUP BY corpus""", "hapax_pct"))
def _(spark, folder):
    return reports.vocabulary_size(corpus_words(spark, folder))


PAIRS = [("en", "fr"), ("en", "de"), ("en", "es"), ("en", "benchmark")]


@add("vocabulary_overlap", s.with_(CORPORA, """tops AS MATERIALIZED (
  SELECT corpus, word FROM corpus_words QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY n DESC, word) <= 5000)""",
  "pairs(l, r) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")") + s.rounded("""
    SELECT l AS "left", r AS "right", CAST((SELECT count(*) FROM (SELECT word FROM tops WHERE corpus = l INTERSECT SELECT word FROM tops WHERE corpus = r)) AS DOUBLE)
      / (SELECT count(*) FROM (SELECT word FROM tops WHERE corpus = l UNION SELECT word FROM tops WHERE corpus = r)) AS jaccard FROM pairs""", "jaccard"))
def _(spark, folder):
    return reports.vocabulary_overlap(corpus_words(spark, folder), PAIRS)


@add("shared_words", s.with_(CORPORA) + """
    SELECT word FROM corpus_words WHERE corpus = 'en' INTERSECT SELECT word FROM corpus_words WHERE corpus = 'fr'""")
def _(spark, folder):
    words = corpus_words(spark, folder)
    return words.filter("corpus = 'en'").select("word").intersect(words.filter("corpus = 'fr'").select("word"))


@add("all_words", s.with_(CORPORA) + "SELECT word FROM corpus_words WHERE corpus = 'en' UNION SELECT word FROM corpus_words WHERE corpus = 'fr'")
def _(spark, folder):
    words = corpus_words(spark, folder)
    return words.filter("corpus = 'en'").select("word").union(words.filter("corpus = 'fr'").select("word")).distinct()


@add("words_of_one_corpus", s.with_(CORPORA) + "SELECT word FROM corpus_words WHERE corpus = 'en' EXCEPT SELECT word FROM corpus_words WHERE corpus <> 'en'")
def _(spark, folder):
    words = corpus_words(spark, folder)
    return words.filter("corpus = 'en'").select("word").subtract(words.filter("corpus <> 'en'").select("word"))


@add("truncation_exposure", s.with_(BY_LANG) + s.rounded(f"""
    SELECT corpus, avg(CAST(words > 256 AS DOUBLE)) * 100.0 AS share_over_256_pct, avg(CAST(words > 512 AS DOUBLE)) * 100.0 AS share_over_512_pct
    FROM (SELECT corpus, {s.word_count('text')} AS words FROM by_lang) GROUP BY corpus""", "share_over_256_pct", "share_over_512_pct"))
def _(spark, folder):
    return reports.truncation_exposure(by_lang(spark, folder))


_EDGES = "[" + ", ".join(f"CAST({e!r} AS DOUBLE)" for e in LENGTH_EDGES) + "]"


@add("length_histogram", s.with_(BY_LANG, f"sized AS MATERIALIZED (SELECT corpus, CAST({s.word_count('text')} AS DOUBLE) AS w FROM by_lang)",
  f"binned AS MATERIALIZED (SELECT corpus, CAST(CASE WHEN w = {LENGTH_EDGES[-1]!r} THEN 44 ELSE len(list_filter({_EDGES}, lambda e: e <= w)) - 1 END AS INTEGER) AS bin FROM sized)") + s.rounded("""
    SELECT corpus, bin, n, CAST(n AS DOUBLE) / total AS share FROM (
      SELECT corpus, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY corpus) AS total FROM binned GROUP BY corpus, bin) WHERE bin BETWEEN 0 AND 44""", "share"))
def _(spark, folder):
    return reports.length_histogram(by_lang(spark, folder))


@add("corpus_balance", s.with_(s.REVIEWS) + s.rounded(
    "SELECT corpus, count(*) AS n, avg(CAST(label AS DOUBLE)) * 100.0 AS positive_pct FROM reviews GROUP BY corpus", "positive_pct"))
def _(spark, folder):
    return reports.balance(reviews(spark, folder))


@add("token_budget", s.with_(s.REVIEWS, s.TOKENS) + s.rounded("""
    SELECT corpus, count(*) AS n_documents, quantile_cont(n, 0.5) AS median_tokens, avg(n) AS mean_tokens, quantile_cont(n, 0.9) AS p90_tokens,
      CAST(max(n) AS INTEGER) AS max_tokens, avg(CAST(n > 256 AS DOUBLE)) * 100.0 AS share_truncated_pct,
      100.0 * CAST(sum(least(n, 256)) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS retained_pct
    FROM (SELECT corpus, len(tokens) AS n FROM review_tokens) GROUP BY corpus""",
    "median_tokens", "mean_tokens", "p90_tokens", "share_truncated_pct", "retained_pct"))
def _(spark, folder):
    return reports.token_budget(review_tokens(spark, folder), by=["corpus"])


@add("integrity", s.with_(s.REVIEWS) + """
    SELECT 'label is 0 or 1' AS rule, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS violations FROM reviews
    UNION ALL SELECT 'text is not empty', count(*) FILTER (coalesce(length(trim(text)), 0) = 0) FROM reviews
    UNION ALL SELECT 'film is known', count(*) FILTER (film_id IS NULL) FROM reviews
    UNION ALL SELECT 'film id has the right form', count(*) FILTER (NOT regexp_matches(film_id, '^src\\d+$')) FROM reviews
    UNION ALL SELECT 'rating agrees with label', count(*) FILTER (NOT ((label = 0 AND rating <= 4) OR (label = 1 AND rating >= 7)))
      FROM (SELECT label, least(10, 1 + length(text) // 500) AS rating FROM reviews)
    UNION ALL SELECT 'reviews per group within cap', count(*) FILTER (n > 15) FROM (SELECT count(*) AS n FROM reviews GROUP BY film_id, label)
    UNION ALL SELECT 'enough films', greatest(25 - count(DISTINCT film_id), 0) FROM reviews""")
def _(spark, folder):
    stars = F.least(F.lit(10), F.lit(1) + F.floor(F.length("text") / F.lit(500)).cast("int"))
    rated = reviews(spark, folder).withColumn("rating", stars)
    return reports.integrity(rated, cap=15, min_films=25, id_pattern=r"^src\d+$")


