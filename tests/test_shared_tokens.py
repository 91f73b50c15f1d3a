"""Tokens and terms that many queries share: counted as numbers, made once, summed in one worker."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlytics.functions import arrow
from reviewlytics.functions import text as tx
from reviewlytics.operators import models
from reviewlytics.plans import base, text_queries
from reviewlytics.runtime import clear_scratch


@pytest.fixture
def folder(spark, tmp_path):
    texts = ["a good film", None, "", "bad &amp; bad", "a good plot", "a bad plot", "not a good film", "it's a bad film"]
    docs = [(i, t, "s", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(t is not None and "good" in t)) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    yield str(tmp_path)
    clear_scratch(spark)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_terms_counted_as_numbers_equal_those_counted_in_the_row(spark, monkeypatch, n):
    monkeypatch.setattr(arrow, "COUNTED_TOKENS", 5)
    rows = [None, [], ["a"], ["a", "b", "a", "b"], ["x y", "x", "y", "x"], ["", "a", ""], ["é", "z_NEG", "n't"] * 4]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows * 5)], "i int, tokens array<string>").coalesce(2)
    c = F.col("tokens")
    both = docs.select(F.array_sort(arrow.count_ngrams(c, n)).alias("x"), F.array_sort(tx.counted(tx.ngrams(c, n))).alias("y"))
    assert both.schema["x"].dataType.simpleString() == both.schema["y"].dataType.simpleString()
    assert both.filter(~F.col("x").eqNullSafe(F.col("y"))).count() == 0


def test_texts_are_made_tokens_once(spark, folder, monkeypatch):
    plans, write = {}, base.settle
    monkeypatch.setattr(base, "settle", lambda df, name: plans.update({name: df}) or write(df, name))
    got = {r["doc_id"]: r for r in base.review_tokens(spark, folder).collect()}
    assert list(plans) == ["tokens"] and "terms_2" not in plans["tokens"].columns
    assert got[3]["tokens"] == ["bad", "bad"] and sorted(map(tuple, got[3]["terms_2"])) == [("bad", 2), ("bad bad", 1)]
    assert not got[1]["terms_2"] and not got[2]["terms_2"]


def test_one_pass_keeps_no_blocks_and_sums_alike(spark, folder):
    docs = base.review_tokens(spark, folder)
    kept, once = (models.shared_vectors("naive_bayes", docs, kept=k) for k in (True, False))
    assert kept.blocks.is_cached and not once.blocks.is_cached
    one, two = kept.naive_bayes((0.5,))[0], once.naive_bayes((0.5,))[0]
    assert one.bias == two.bias and np.allclose(one.weights, two.weights, atol=1e-12)
    kept.close()
    once.close()


def test_scaled_features_weigh_terms_once(spark, folder, monkeypatch):
    calls, plain = [], text_queries.feat.tfidf
    monkeypatch.setattr(text_queries.feat, "tfidf", lambda *a, **k: calls.append(1) or plain(*a, **k))
    rows = text_queries.registry.queries["ratio_scaled_features"](spark, folder).collect()
    assert rows and len(calls) == 1


def test_bare_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ("a_NEG", "_NEGa", "a_NEG_NEG", "", None, "a_NEG\n")], "t string")
    both = rows.select(tx.bare(F.col("t")).alias("x"), F.regexp_replace("t", "_NEG$", "").alias("y"))
    assert all(r["x"] == r["y"] for r in both.collect())
