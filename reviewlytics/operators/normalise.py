"""Switchable text normalisation: texts in, token arrays out."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions import text as tx
from reviewlytics.functions.arrow import replace_tokens, stem_tokens
from reviewlytics.runtime import BROADCAST_BYTES, measured_bytes, settle


@dataclass(frozen=True)
class Recipe:
    """Which steps run; their order is fixed.

    clean, tokenise, mark negation, minimum length, stop words, normalise.
    """

    remove_stopwords: bool = True
    keep_negations: bool = True
    normalisation: str = "lemma"
    negation_marking: bool = False
    min_token_length: int = 2

    def __post_init__(self) -> None:
        if self.normalisation not in ("none", "stem", "lemma"):
            raise ValueError("normalisation must be 'none', 'stem' or 'lemma'")

    def describe(self) -> str:
        return ", ".join(f"{name}: {value}" for name, value in self.to_dict().items())

    def to_dict(self) -> dict:
        return asdict(self)


DEFAULT = Recipe(remove_stopwords=False, normalisation="lemma")
PRESCRIBED = Recipe(keep_negations=False, normalisation="stem")
RAW = Recipe(remove_stopwords=False, normalisation="none")

# The ablation's named configurations.
RECIPES = {
    "raw": RAW,
    "sw-naive": Recipe(keep_negations=False, normalisation="none"),
    "sw-keepneg": Recipe(normalisation="none"),
    "sw-keepneg+stem": Recipe(normalisation="stem"),
    "sw-keepneg+lemma": Recipe(normalisation="lemma"),
    "sw-naive+stem": PRESCRIBED,
    "lemma-only": DEFAULT,
    "sw-keepneg+lemma+negmark": Recipe(normalisation="lemma", negation_marking=True),
}


def filtered_tokens(cleaned, recipe: Recipe):
    """Every step up to stop words, as one column expression."""
    tokens = tx.tokenize(cleaned)
    if recipe.negation_marking:
        tokens = tx.mark_negation(tokens)
    if recipe.min_token_length > 1:
        tokens = tx.drop_short(tokens, recipe.min_token_length)
    if recipe.remove_stopwords:
        tokens = tx.drop_stop_words(tokens, recipe.keep_negations)
    return tokens


def composed_lemmas(lemmas: DataFrame) -> DataFrame:
    """``surface, lemma`` of the dictionary: the verb lemma, then the noun lemma of that.

    ``lemmas`` is ``surface, pos ('v' or 'n'), lemma``. Of several lemmas of a
    surface and part of speech the first by name counts.
    """
    first = lemmas.groupBy("surface", "pos").agg(F.min("lemma").alias("lemma"))
    verbs = first.filter("pos = 'v'").select("surface", F.col("lemma").alias("_mid"))
    nouns = first.filter("pos = 'n'").select(F.col("surface").alias("_mid"), F.col("lemma").alias("_noun"))
    both = verbs.join(nouns.withColumnRenamed("_mid", "surface"), "surface", "full").withColumn("_mid", F.coalesce("_mid", "surface"))
    return both.drop("_noun").join(nouns, "_mid", "left").select("surface", F.coalesce("_noun", "_mid").alias("lemma"))


def lemmatise(docs: DataFrame, lemmas: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each token by its verb lemma, then by the noun lemma of that.

    Verb and noun lemmas are composed on the dictionary, once. A composed
    dictionary of measured size is sent to all tasks, where each text's tokens
    are looked up as numbers; texts are not shuffled. A larger one is joined:
    one shuffle, by row, puts the tokens back in order. Tokens without an entry
    stay. ``keys`` identify a row of ``docs``.
    """
    composed = settle(composed_lemmas(lemmas), "composed-lemmas")
    if measured_bytes(composed) <= BROADCAST_BYTES:
        return replace_tokens(docs, composed)
    rest = [c for c in docs.columns if c != "tokens" and c not in keys]
    spread = docs.select(*keys, *rest, F.posexplode_outer("tokens").alias("_pos", "_token"))
    bare = spread.withColumn("surface", tx.bare(F.col("_token")))
    found = bare.join(composed.hint("merge"), "surface", "left").withColumn("_new", F.concat(
        F.coalesce("lemma", "surface"), F.when(F.endswith("_token", F.lit("_NEG")), "_NEG").otherwise("")
    ))
    ordered = F.sort_array(F.collect_list(
        F.when(F.col("_pos").isNotNull(), F.struct(F.col("_pos").alias("p"), F.col("_new").alias("t")))
    ))
    return found.groupBy(*keys, *rest).agg(F.transform(ordered, lambda x: x["t"]).alias("tokens"))


def normalise(
    docs: DataFrame, recipe: Recipe, text: str = "text", keys: list[str] | None = None,
    lemmas: DataFrame | None = None, letters: str = "ascii",
) -> DataFrame:
    """Replace the text column by ``tokens``."""
    if recipe.normalisation == "lemma" and lemmas is None:
        raise ValueError("a lemma recipe needs a lemma table")
    cleaned = tx.clean_text(F.col(text), letters)
    out = docs.withColumn("tokens", filtered_tokens(cleaned, recipe)).drop(text)
    if recipe.normalisation == "stem":
        return out.withColumn("tokens", stem_tokens(F.col("tokens")))
    if recipe.normalisation == "lemma":
        return lemmatise(out, lemmas, keys or ["doc_id"])
    return out


def joined_text(tokens="tokens"):
    return F.array_join(tokens, " ")
