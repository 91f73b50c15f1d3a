"""Shared handling of documents: row keys, Arrow pieces, broadcast-free lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
PIECE_BYTES = 4 << 20


def row_key(id_col: str, text_col: str):
    """The columns ``doc`` and ``tag`` of a row: its id, and a hash of its text."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """``doc``, ``tag``, ``text``: two columns, never null, that tell rows apart, and the text, null as empty.

    ``tag`` hashes the text (64 bits: among rows without an id nothing else tells
    texts apart), so rows that repeat a doc_id with other texts stay apart and
    rows that repeat both are equal in every respect.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc, tag = row_key(id_col, text_col)
    return docs.select(doc.alias("doc"), tag.alias("tag"), text.alias("text"), *more)


def given_id(name: str = "doc"):
    """The id as it was given; rows without one get null back."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        at = size = 0
        for i, n in enumerate(lengths.tolist()):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        yield batch.slice(at)


def replaced(docs: DataFrame, id_col: str, text_col: str, change: DataFrame, how: str = "left") -> DataFrame:
    """``docs``, whole rows, joined with ``change`` on their row keys (``__doc``, ``__tag``)."""
    doc, tag = row_key(id_col, text_col)
    return docs.withColumns({"__doc": doc, "__tag": tag}).join(change, ["__doc", "__tag"], how).drop("__doc", "__tag")
