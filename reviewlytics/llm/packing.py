"""Best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.llm.bpe import encoded, library_encoder
from reviewlytics.llm.rows import given_id, keyed, pieces
from reviewlytics.runtime import settle, ship_package

#: Pieces of one length are numbered in independent parts of about so many rows.
PART_ROWS = 1 << 16


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc``, ``tag``, ``piece``, ``start``, ``length``, ``ids_crc32``: each text's ids and its end id, cut where too long.

    All pieces of a text but the first are full. Null and empty texts are one
    piece of the end id. Null ids and rows that repeat an id are rows like
    others, an empty table gives no rows, extra columns are not looked at. No
    shuffle.
    """
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for i, ids in enumerate(encoded(batch, library_encoder(path))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows.extend((i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
            row, piece, start, length, crc = (np.array(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].take(pa.array(row)), batch["tag"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                ["doc", "tag", "piece", "start", "length", "ids_crc32"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(cut, "doc long, tag long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Which bins the pieces of each length go to, from their counts alone.

    Rows (length, first rank, end rank, first bin, pieces a bin, offset): the
    pieces of that length with these ranks fill consecutive bins, so many in
    each, from that offset on. Ranks count from 0 within a length.

    Lengths above a third of the capacity meet at most twice in a bin: longest
    first, each is matched with the longest that still fits. Smaller ones,
    longest first, go where the least room is left. The work depends on the
    number of distinct lengths, which the capacity bounds, not on the pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    by_gap: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(length: int, many: int, first: int, each: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + many, first, each, offset))
        used[length] += many
        left[length] -= many

    def open_bins(many: int, fill: int) -> None:
        nonlocal bins
        if fill < capacity:
            by_gap.setdefault(capacity - fill, []).append((bins, many))
        bins += many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] and (m != n or left[n] > 1)), None)
            if mate is None:
                many = left[n]
                put(n, many, bins, 1, 0)
                open_bins(many, n)
            elif mate == n:
                many = left[n] // 2
                put(n, 2 * many, bins, 2, 0)
                open_bins(many, 2 * n)
            else:
                many = min(left[n], left[mate])
                put(n, many, bins, 1, 0)
                put(mate, many, bins, 1, n)
                open_bins(many, n + mate)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in by_gap if g >= n):
            stay = []
            for first, many in by_gap.pop(gap):
                each = gap // n
                full = min(many, left[n] // each)
                if full:
                    put(n, full * each, first, each, capacity - gap)
                    if gap > each * n:
                        by_gap.setdefault(gap - each * n, []).append((first, full))
                first, many = first + full, many - full
                if many and left[n]:
                    some = left[n]
                    put(n, some, first, some, capacity - gap)
                    by_gap.setdefault(gap - some * n, []).append((first, 1))
                    first, many = first + 1, many - 1
                if many:
                    stay.append((first, many))
            if stay:
                by_gap.setdefault(gap, []).extend(stay)
            if not left[n]:
                break
        if left[n]:
            each = capacity // n
            full, some = divmod(left[n], each)
            for many, size in ((full, each), (1 if some else 0, some)):
                if many:
                    put(n, many * size, bins, size, 0)
                    open_bins(many, size * n)
    return rows


def best_fit(rows: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: lengths of 1 to ``capacity`` packed into few sequences.

    Only counts per length reach the driver: ``capacity`` numbers at most. A
    length is numbered in as many parts as its rows fill, so no length has to be
    sorted by one task. ``rows`` must not change from use to use. Ties of
    ``order`` are broken in any way: such rows are equal in it. Null ids are
    for the caller to name; extra columns, and repeated rows, stay as they are;
    an empty table stays empty.
    """
    total = {x[0]: x[1] for x in rows.groupBy(length_col).agg(F.count(F.lit(1))).collect()}
    spark = rows.sparkSession
    n_parts = spark.createDataFrame([(n, c // PART_ROWS + 1) for n, c in total.items()], f"{length_col} long, __parts long")
    # One row per length: the capacity bounds it.
    parts = rows.join(F.broadcast(n_parts), length_col).withColumn("__part", F.pmod(F.xxhash64(*order), F.col("__parts"))).drop("__parts")
    counts = parts.groupBy(length_col, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(length_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "length-counts")
    schema = f"{length_col} long, __lo long, __hi long, __bin long, __each long, __at long"
    bins = spark.createDataFrame(plan(total, capacity), schema)
    place = F.row_number().over(Window.partitionBy(length_col, "__part").orderBy(*order)) - 1
    ranked = parts.withColumn("__place", place).join(counts.drop("__n"), [length_col, "__part"])
    ranked = ranked.withColumn("__rank", F.col("__place") + F.col("__before"))
    turn = F.col("__rank") - F.col("__lo")
    # The plan has a bounded number of rows: some for each length up to the capacity.
    return ranked.join(F.broadcast(bins), length_col).filter("__rank >= __lo and __rank < __hi").select(
        *rows.columns, (F.col("__bin") + F.floor(turn / F.col("__each"))).alias("sequence_id"),
        (F.col("__at") + turn % F.col("__each") * F.col(length_col)).alias("offset"),
    )


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
) -> DataFrame:
    """All texts, tokenized and cut, packed into sequences of at most ``capacity`` tokens: one row per piece.

    Columns: doc_id, tag (hash of the text), piece, start, length, ids_crc32,
    sequence_id, offset. Null and empty texts are one piece of the end id.
    Rows that repeat an id, or have none, are packed like others. Extra
    columns are not looked at.
    """
    cut = settle(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    packed = best_fit(cut, capacity, ["doc", "tag", "piece"])
    return packed.select(given_id().alias("doc_id"), "tag", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
