"""Arrow functions for the few steps no built-in expresses. All are narrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.functions.stem import porter_stem


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem(tokens: pa.Array) -> pa.Array:
    """Stem the distinct tokens of the batch once and spread them back."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    flat = pc.dictionary_encode(tokens.flatten())
    stems = []
    for token in flat.dictionary.to_pylist():
        marked = token.endswith("_NEG")
        stem = porter_stem(token[:-4] if marked else token)
        stems.append(stem + "_NEG" if marked else stem)
    values = pa.array(stems, pa.string()).take(flat.indices)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_pylist()
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=tokens.is_null())


def _unescaper():
    """A function that takes nothing of this package along, so cleaning needs no package on the workers."""
    def unescape(text: pa.Array) -> pa.Array:
        from html import unescape as decoded

        import pyarrow

        return pyarrow.array([None if t is None else decoded(t) for t in text.to_pylist()], pyarrow.string())

    return F.arrow_udf(unescape, T.StringType())


_unescape = _unescaper()


def stem_tokens(tokens: Column) -> Column:
    """Porter stems of a token array; negation marks are kept."""
    return _stem(tokens)


#: Tokens whose terms are counted at a time.
COUNTED_TOKENS = 1 << 18


def _grams(flat: pa.Array, doc: np.ndarray, ngram_max: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The n-grams of the tokens of some documents, by length, as (document, number of the term) and the terms by number.

    Only distinct n-grams are joined to strings.
    """
    words = pc.dictionary_encode(flat)
    code, names = np.asarray(words.indices).astype(np.int64), words.dictionary
    gram, gram_doc, gram_names = code, doc, names
    docs, numbers, terms, so_far = [doc], [code], [names], len(names)
    for n in range(2, ngram_max + 1):
        same = np.flatnonzero(doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)])
        # ``gram`` holds one number per place where a shorter gram starts; ``at`` finds those that can be made longer.
        at = same if n == 2 else np.searchsorted(starts, same)
        pairs, gram = np.unique(gram[at] * len(names) + code[same + n - 1], return_inverse=True)
        left, right = gram_names.take(pa.array(pairs // max(1, len(names)))), names.take(pa.array(pairs % max(1, len(names))))
        starts, gram_doc, gram_names = same, doc[same], pc.binary_join_element_wise(left, right, " ")
        docs.append(gram_doc)
        numbers.append(gram.reshape(-1) + so_far)
        terms.append(gram_names)
        so_far += len(gram_names)
    number, term = np.concatenate(numbers), pa.concat_arrays(terms)
    if pc.any(pc.match_substring(names, " ")).as_py():  # then n-grams of different words may be the same string
        unified = pc.dictionary_encode(term)
        number, term = np.asarray(unified.indices).astype(np.int64)[number], unified.dictionary
    return np.concatenate(docs), number, term


def _counted(tokens: pa.Array, ngram_max: int) -> pa.Array:
    """Distinct n-grams of each list with their counts, in the order of n and of the text; null for null and empty lists."""
    n_docs = len(tokens)
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    doc, number, term = _grams(tokens.flatten(), np.repeat(np.arange(n_docs), size), ngram_max)
    key = doc * max(1, len(term)) + number
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    first, tf = order[start], np.diff(np.append(start, len(key)))
    inside = np.argsort(doc[first] * max(1, len(key)) + first)
    first, tf = first[inside], tf[inside].astype(np.int32)
    ends = np.cumsum(np.bincount(doc[first], minlength=n_docs))
    rows = pa.StructArray.from_arrays([term.take(pa.array(number[first])), pa.array(tf)], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), rows, mask=pa.array(size == 0))


def count_ngrams(tokens: Column, ngram_max: int = 2) -> Column:
    """``array<struct<term, tf>>`` of a token array without nulls: the terms and counts of ``text.counted(text.ngrams(...))``, in another order.

    Equal arrays give equal rows, whatever batch they are in.
    """
    def count(tokens: pa.Array) -> pa.Array:
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        whole = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        out, at = [], 0
        while at < len(tokens) or not out:
            before = whole[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(whole, before + COUNTED_TOKENS, side="right")))
            out.append(_counted(tokens.slice(at, to - at), ngram_max))
            at = to
        return pa.concat_arrays(out)

    shape = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
    return F.arrow_udf(count, shape)(tokens)


def replace_tokens(docs: DataFrame, table: DataFrame, column: str = "tokens") -> DataFrame:
    """``docs`` with the tokens that ``table`` (surface, value; each surface once) holds replaced; negation marks are kept.

    The table is sent to the workers as it is: its size is for the caller to
    check. Tokens of a batch are looked up as numbers of its distinct tokens.
    """
    found = table.toArrow()
    surfaces, values = (pa.array(found[i].to_pylist(), pa.string()) for i in (0, 1))
    sent = docs.sparkSession.sparkContext.broadcast((surfaces, values))

    def replaced(batches):
        surfaces, values = sent.value
        for batch in batches:
            tokens = batch[column]
            flat = pc.dictionary_encode(tokens.flatten())
            own = flat.dictionary
            marked = pc.ends_with(own, "_NEG")
            bare = pc.if_else(marked, pc.utf8_slice_codeunits(own, 0, -4), own)
            value = pc.coalesce(values.take(pc.index_in(bare, value_set=surfaces)), bare)
            value = pc.if_else(marked, pc.binary_join_element_wise(value, "_NEG", ""), value).take(flat.indices)
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0)).to_pylist()
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), value, mask=tokens.is_null())
            yield pa.RecordBatch.from_arrays([lists if c == column else batch[c] for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(replaced, docs.schema)


def decode_entities(text: Column) -> Column:
    """Every HTML5 entity of every text; null stays null."""
    return _unescape(text)


def unescape_html_fully(text: Column) -> Column:
    """Every HTML5 entity, also unterminated ones.

    All texts that hold an ampersand travel to the Python worker.
    """
    needed = F.when(F.contains(text, F.lit("&")), text)
    return F.coalesce(_unescape(needed), text)
