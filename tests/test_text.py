import html
import random

import pytest
from pyspark.sql import functions as F

from reviewlytics.config import NEGATION_CUES
from reviewlytics.functions import text as tx
from reviewlytics.functions.arrow import stem_tokens, unescape_html_fully
from reviewlytics.functions.stem import porter_stem
from reviewlytics.operators.normalise import DEFAULT, Recipe, normalise


def one(spark, value, expression, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expression(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw, cleaned", [
    ("Fine acting.<br /><br />Truly.", "fine acting truly"),
    ("They said &quot;superb&quot;.", "they said superb"),
    ("SPLENDID", "splendid"),
    ("sooooo slow", "soo slow"),
    ("I can't stay", "i can't stay"),
    ("Scored 9/10 -- neat!", "scored neat"),
    ("&lt;br&gt;gone", "gone"),
    ("caf&eacute; bar", "caf bar"), ("caf&#xe9; bar", "caf bar"), ("caf&eacute bar", "caf bar"), ("a&nbspb nice", "a b nice"),
    ("good &amp bad", "good bad"), ("&#105;t is", "it is"), ("&LT;br&GT;gone", "gone"), ("x &#x3C;br&#x3E; y", "x y"),
    ("&amp;lt;br&amp;gt; kept", "lt br gt kept"), ("five & six &amp; seven", "five six seven"), ("&am&#112;", "amp"),
    ("", ""), (" \n\t ", ""), ("<p></p>", ""),
])
def test_cleaning(spark, raw, cleaned):
    assert one(spark, raw, tx.clean_text) == cleaned


def test_full_unescape_handles_unterminated_entities(spark):
    assert one(spark, "a &amp b &hearts; c", unescape_html_fully) == "a & b ♥ c"


def test_both_ways_of_unescaping_agree(spark):
    rng = random.Random(5)
    parts = ["&", "&amp;", "&amp", "&lt;", "&LT;", "&lt", "&nbsp;", "&nbspx", "&#38;", "&#x26;lt;", "&#39;", "&#105", "&apos;", "&apos",
             "&fjlig;", "&notit;", "&nosuch;", "&#", "&#x;", "&;", "&#0;", "&#150;", "&#xD800;", "a", " ", ";", "#38;", "amp;", "\n", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in rows.select("i", tx.unescape_html(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else html.unescape(t) for t in texts]


def test_clitics_and_joined_words(spark):
    got = one(spark, "don't they'll cannot gonna dog's", lambda c: tx.tokenize(c))
    assert got == ["do", "n't", "they", "'ll", "can", "not", "gon", "na", "dog", "'s"]


def loop_marks(tokens, scope):
    out, left = [], 0
    for t in tokens:
        out.append(t + "_NEG" if left > 0 else t)
        left = scope if t in NEGATION_CUES or t.endswith("n't") else max(0, left - 1)
    return out


def test_negation_scope_equals_the_loop(spark):
    rng = random.Random(3)
    lists = [[rng.choice(["not", "a", "good", "n't", "never", "plot"]) for _ in range(rng.randrange(12))]
             for _ in range(200)]
    for scope in (1, 2, 3):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
        got = {r.i: r.m for r in rows.select("i", tx.mark_negation(F.col("t"), scope).alias("m")).collect()}
        assert [got[i] for i in range(len(lists))] == [loop_marks(t, scope) for t in lists]


def test_stop_lists():
    aware, naive = tx.stop_words(True), tx.stop_words(False)
    assert not {"not", "no", "but"} & set(aware)
    assert {"not", "no"} <= set(naive) and "the" in aware


def test_counted_terms_equal_a_counter(spark):
    tokens = "a b a c b a".split()
    got = one(spark, tokens, lambda c: tx.counted(tx.ngrams(c)), "v array<string>")
    assert {r.term: r.tf for r in got} == {
        "a": 3, "b": 2, "c": 1, "a b": 1, "b a": 2, "a c": 1, "c b": 1,
    }


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"),
    ("beautifully", "beauti"), ("happy", "happi"), ("adjustable", "adjust"), ("sky", "sky"),
])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_stems_keep_marks_and_nulls(spark):
    df = spark.createDataFrame([(["running", "loved_NEG"],), (None,), ([],)], "v array<string>")
    got = [r[0] for r in df.select(stem_tokens(F.col("v"))).collect()]
    assert got == [["run", "love_NEG"], None, []]


def test_recipes(spark):
    docs = spark.createDataFrame([(1, "not good"), (2, "good"), (3, "<br />")], "doc_id int, text string")

    def tokens(recipe, **kw):
        return {r.doc_id: r.tokens for r in normalise(docs, recipe, **kw).collect()}

    naive = tokens(Recipe(keep_negations=False, normalisation="none"))
    assert naive[1] == naive[2] == ["good"] and naive[3] == []
    assert tokens(Recipe(normalisation="none"))[1] == ["not", "good"]
    assert tokens(Recipe(normalisation="none", negation_marking=True))[1] == ["not", "good_NEG"]
    with pytest.raises(ValueError):
        Recipe(normalisation="soundex")
    with pytest.raises(ValueError):
        normalise(docs, DEFAULT)


def test_lemmas_verb_then_noun_in_order(spark):
    lemmas = spark.createDataFrame([("loved", "v", "loves"), ("loves", "n", "love")], "surface string, pos string, lemma string")
    docs = spark.createDataFrame([(1, "she loved films loved"), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in normalise(docs, DEFAULT, lemmas=lemmas).collect()}
    assert got == {1: ["she", "love", "films", "love"], 2: []}
    assert "normalisation: lemma" in DEFAULT.describe()
