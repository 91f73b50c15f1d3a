"""Cleaning, tokens, negation scope and stop words as column expressions.

Everything here is narrow: one row in, one row out, no shuffle, no Python
worker (the exceptions, stemming and the decoding of rare entities, are Arrow
functions in :mod:`reviewlytics.functions.arrow`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlytics.functions.arrow import decode_entities

from reviewlytics.config import (
    ENGLISH_STOP_WORDS,
    ENTITIES,
    NEGATION_CUES,
    PROBES,
    SENTIMENT_FUNCTION_WORDS,
)

# Clitic rules of the Penn Treebank convention that can still
# fire on cleaned text (letters, blanks and apostrophes), applied in order to
# the text padded with one blank on each side.
CLITIC_RULES = (
    ("( )('')", "$1 `` "),
    ("([^'])' ", "$1 ' "),
    ("''", " '' "),
    ("([^' ])('s|'m|'d|') ", "$1 $2 "),
    ("([^' ])('ll|'re|'ve|n't) ", "$1 $2 "),
    (r"\b(d)('ye)\b", " $1 $2 "),
    (r"\b(more)('n)\b", " $1 $2 "),
    (r" ('t)(is|was)\b", " $1 $2 "),
)

# Words written as one that the same convention splits in two.
JOINED_WORDS = (
    ("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"),
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def unescape_html(text: Column) -> Column:
    """Every HTML5 entity to its characters: named, numeric, also unterminated.

    Texts whose entities are all common ones stay in the JVM. Any other
    ampersand before a letter or ``#`` sends its text, and no other text, to
    the full decoder. Both give the same characters.
    """
    common = "|".join(entity[1:-1] for entity, _ in ENTITIES)
    uncommon = F.rlike(text, F.lit(f"&(?=[A-Za-z#])(?!(?:{common});)"))
    out = text
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    plain = F.when(F.contains(text, F.lit("&")), out).otherwise(text)
    return F.coalesce(decode_entities(F.when(uncommon, text)), plain)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def squeeze_runs(text: Column) -> Column:
    """Three or more of the same character become two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def keep_letters(text: Column, letters: str = "ascii") -> Column:
    """Only letters, blanks and apostrophes, single-spaced and trimmed.

    ``letters="unicode"`` keeps accented letters for non-English text.
    """
    other = {"ascii": "[^a-z']+", "unicode": r"[^\p{L}']+"}[letters]
    return F.trim(F.regexp_replace(text, other, " "))


def clean_text(text: Column, letters: str = "ascii") -> Column:
    """Markup, case, character runs and non-letters, in that order."""
    return keep_letters(squeeze_runs(F.lower(strip_tags(unescape_html(text)))), letters)


def words(text: Column) -> Column:
    """Non-empty pieces between whitespace."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokenize(cleaned: Column) -> Column:
    """Tokens of cleaned text, clitics split off (``don't`` -> ``do``, ``n't``)."""
    joined = "|".join(f"{a}(?={b}\\b)" for a, b in JOINED_WORDS)

    def pieces(c: Column) -> Column:
        split = F.concat(F.lit(" "), c, F.lit(" "))
        for pattern, replacement in CLITIC_RULES:
            split = F.regexp_replace(split, pattern, replacement)
        spaced = F.when(F.contains(c, F.lit("'")), F.trim(split)).otherwise(c)
        return F.split(F.regexp_replace(spaced, rf"\b({joined})", "$1 "), " +")

    return let(cleaned, lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(pieces(c)))


def is_cue(token: Column) -> Column:
    return token.isin(*NEGATION_CUES) | F.endswith(token, F.lit("n't"))


def mark_negation(tokens: Column, scope: int = 3) -> Column:
    """Append ``_NEG`` to the ``scope`` tokens after each negation cue.

    A token is inside a scope exactly when one of the ``scope`` tokens before
    it is a cue, so no running state is needed.
    """
    def marked(pair: Column) -> Column:
        toks, cues = pair["toks"], pair["cues"]
        return F.transform(
            toks,
            lambda t, i: F.when(
                F.array_contains(
                    F.slice(cues, F.greatest(i - scope + 1, F.lit(1)), F.least(i, F.lit(scope))),
                    True,
                ),
                F.concat(t, F.lit("_NEG")),
            ).otherwise(t),
        )

    pair = F.struct(tokens.alias("toks"), F.transform(tokens, is_cue).alias("cues"))
    return let(pair, marked)


def bare(token: Column) -> Column:
    """The token without its negation mark."""
    return F.when(F.contains(token, F.lit("_NEG")), F.regexp_replace(token, "_NEG$", "")).otherwise(token)


def stop_words(keep_negations: bool = True) -> list[str]:
    if not keep_negations:
        return list(ENGLISH_STOP_WORDS)
    kept = set(SENTIMENT_FUNCTION_WORDS)
    return [w for w in ENGLISH_STOP_WORDS if w not in kept]


def drop_stop_words(tokens: Column, keep_negations: bool = True) -> Column:
    stops = stop_words(keep_negations)
    return F.filter(tokens, lambda t: ~bare(t).isin(*stops))


def drop_short(tokens: Column, min_length: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.length(bare(t)) >= min_length)


def ngrams(tokens: Column, n_max: int = 2) -> Column:
    """All word n-grams of length 1 to ``n_max``, joined with a blank."""
    def grams(n: int, t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
        made = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i + (k - 1)) for k in range(n)]))
        return F.coalesce(made, F.array().cast("array<string>"))

    if n_max == 1:
        return tokens
    return let(tokens, lambda t: F.concat(t, *[grams(n, t) for n in range(2, n_max + 1)]))


def counted(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of the distinct terms of one row.

    Sorting the array puts equal terms side by side, so a term's count is the
    distance between starts of runs. No shuffle, n log n in the row's length.
    """
    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda i, k: F.struct(
                    F.get(s, i).alias("term"),
                    (F.coalesce(F.get(b, k + 1), n) - i).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), runs)


def probe_flags(text: Column, probes=PROBES) -> list[Column]:
    """One boolean column per construction, case-insensitive.

    Word boundaries follow Unicode on every Java version, hence the ``U``.
    """
    return [F.rlike(text, F.lit(f"(?iU){pattern}")).alias(name) for name, pattern in probes]
