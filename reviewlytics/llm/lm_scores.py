"""Cross-entropy difference of two bigram models, learnt from labelled and from all texts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.rows import given_id, keyed, pieces
from reviewlytics.llm.wordhash import Words, mix
from reviewlytics.runtime import lookup, release, settle, ship_package

#: Weight of the word model behind each bigram count.
SMOOTHING = 100.0
GROUP_TOKENS = 3 << 20
PART_KEYS = 1 << 20
RANGES = 64
HELD = 1 << 20
_START = np.uint64(0x5851F42D4C957F2D)
_PAIR, _WORD, _HISTORY = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _tally(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    own, where = np.unique(keys, return_inverse=True)
    return (own, *(np.bincount(where, w, len(own)).astype(np.int64) for w in weights))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n, target): the words of a task and how many stand in target texts, added up before they leave it."""
    held = []

    def flush() -> pa.RecordBatch:
        h, n, t = _tally(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(t)], ["hash", "n", "target"])

    for batch in pieces(batches):
        words = Words(batch["text"], lower=True)
        held.append(_tally(words.hash, np.ones(len(words.hash), np.int64), np.repeat(np.asarray(batch["target"]), words.counts())))
        if sum(len(x[0]) for x in held) > HELD:
            yield flush()
    if held:
        yield flush()


def _keys(texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Tokens per text, and per token the keys of its bigram, of its word and of its history. Keys of different kinds differ."""
    words = Words(texts, lower=True)
    ids, sizes = words.hash, words.counts()
    before = np.empty(len(ids), np.uint64)
    before[1:] = ids[:-1]
    before[words.first[:-1][sizes > 0]] = _START
    return sizes, (mix(mix(before ^ _PAIR) + ids), mix(ids ^ _WORD), mix(before ^ _HISTORY))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, one plane per byte, compressed (128 on the width) where that is less.

    The upper planes hold few values: an entropy code saves there what the shuffle's own compression can't.
    """
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    small = pa.compress(planes, codec="zstd", asbytes=True) if planes else planes
    return bytes([width | 128]) + small if len(small) < len(planes) else bytes([width]) + planes


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width, planes = data[0] & 127, data[1:]
    if data[0] & 128:
        planes = pa.decompress(planes, decompressed_size=width * n, codec="zstd", asbytes=True)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _slice(part: int, keys: np.ndarray, target: np.ndarray, every: np.ndarray, shift: int) -> tuple:
    """Ascending keys of one part of the key space, as distances, with their counts."""
    base = np.uint64(part << shift) if shift < 64 else np.uint64(0)
    return len(keys), _packed(np.diff(keys, prepend=base)), _packed(target), _packed(every)


def _opened(part: int, n: int, keys: bytes, target: bytes, every: bytes, shift: int) -> tuple[np.ndarray, ...]:
    base = np.uint64(part << shift) if shift < 64 else np.uint64(0)
    return np.cumsum(_unpacked(keys, n), dtype=np.uint64) + base, _unpacked(target, n), _unpacked(every, n)


_SLICE = ["part", "group", "n", "keys", "target", "every"]
_SLICE_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _slices(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SLICE_TYPES, strict=True)], _SLICE)


def _key_counts(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """The counts within each group, cut into the parts of the key space."""
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        """Range by range of the key space, so that the group's keys are never all in one array."""
        edges = np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES)
        cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k, _, _ in held]
        rows = []
        for i in range(RANGES):
            own = [[x[c[i] : c[i + 1]] for x in columns] for columns, c in zip(held, cuts, strict=True)]
            k, t, n = _tally(*map(np.concatenate, zip(*own, strict=True)))
            part = (k >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(k), np.int64)
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            rows += [(int(part[a]), now, *_slice(int(part[a]), k[a:b], t[a:b], n[a:b], shift)) for a, b in itertools.pairwise([*starts, len(k)])]
            # A part may go on in the next range.
            while len(rows) > 64:
                yield _slices(rows[:64])
                del rows[:64]
        held.clear()
        if rows:
            yield _slices(rows)

    for batch in pieces(batches):
        group = np.asarray(batch["group"])
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        for a, b in itertools.pairwise(cuts.tolist()):
            if now != group[a] and held:
                yield from flush()
            now = int(group[a])
            part = batch.slice(a, b - a)
            sizes, keys = _keys(part["text"])
            if sizes.any():
                target = np.repeat(np.asarray(part["target"]), sizes)
                for k in keys:
                    own, t, n = _tally(k, target, np.ones(len(k), np.int64))
                    held.append((own, t.astype(np.int32), n.astype(np.int32)))
    if held:
        yield from flush()


def _totals(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """The slices of each part, added up over all groups; each group gets back its keys that stand twice anywhere."""
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        opened = [_opened(now, *x[1:], shift) for x in held]
        keys, back = np.unique(np.concatenate([x[0] for x in opened]), return_inverse=True)
        target, every = (np.bincount(back, np.concatenate([x[i] for x in opened]), len(keys)).astype(np.int64) for i in (1, 2))
        at, rows = 0, []
        for x, (own, _, _) in zip(held, opened, strict=True):
            where = back[at : at + len(own)]
            at += len(own)
            where = where[every[where] > 1]
            if len(where):
                rows.append((now, x[0], *_slice(now, keys[where], target[where], every[where], shift)))
        held.clear()
        for i in range(0, len(rows), 64):
            yield _slices(rows[i : i + 64])

    for batch in batches:
        for part, *rest in zip(*(batch[c].to_pylist() for c in _SLICE), strict=True):
            if part != now and held:
                yield from flush()
            now = part
            held.append(rest)
    if held:
        yield from flush()


_SCORED = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])


def _score(texts: pa.Table, slices: pa.Table, sums: tuple[int, int], slots: int, shift: int) -> pa.Table:
    """Losses of the texts of a group, with the corpus counts of its keys."""
    table = np.empty(0, np.uint64), np.empty((2, 0), np.int64)
    if slices.num_rows:
        opened = [_opened(*x, shift) for x in zip(*(slices[c].to_pylist() for c in ("part", "n", "keys", "target", "every")), strict=True)]
        opened.sort(key=lambda x: int(x[0][0]))
        keys, target, every = (np.concatenate(x) for x in zip(*opened, strict=True))
        table = keys, np.stack([target, every]).astype(np.int64)
    out = []
    for rows in pieces(texts.combine_chunks().to_batches()):
        sizes, own = _keys(rows["text"])
        # Keys that the table doesn't have stand once in the corpus: here.
        once = np.stack([np.repeat(np.asarray(rows["target"]), sizes), np.ones(len(own[0]), np.int64)])
        counts = []
        for k in own:
            at = np.minimum(np.searchsorted(table[0], k), max(len(table[0]) - 1, 0))
            counts.append(np.where(table[0][at] == k, table[1][:, at], once) if len(table[0]) else once)
        owner, losses = np.repeat(np.arange(len(sizes)), sizes), []
        for total, pair, word, history in zip(sums, *counts, strict=True):
            chance = (pair + SMOOTHING * (word + 1) / (total + slots)) / (history + SMOOTHING)
            losses.append(np.bincount(owner, -np.log2(chance), len(sizes)) / np.maximum(sizes, 1))
        out.append(pa.RecordBatch.from_arrays([rows["doc"], rows["tag"], pa.array(sizes, pa.int64()), *map(pa.array, losses)], schema=_SCORED))
    return pa.Table.from_batches(out, _SCORED)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Loss per token of each text under a target and a background model, and their difference (less is more like the target).

    ``target`` holds the ids (column ``id_col``) of the texts that the target
    model is learnt from; the background model is learnt from all texts, those
    of the target included. Both are bigram models over the words of all texts,
    backed by word models, and share one vocabulary. Columns: doc_id, tag,
    n_tokens, target_loss, background_loss, difference.

    Words, bigrams and histories (a bigram's first word, or the start of a
    text) are known by 64-bit hashes. Texts are dealt by a hash into groups of
    some three million tokens, and the hashes of keys into parts of some
    million. A group sends each part a slice: its keys there, once, ascending,
    with their counts. A part adds these up and sends each group the corpus
    counts of its keys that stand twice anywhere. Only the numbers of tokens and
    words pass the driver.

    Null and empty texts have no tokens and losses of 0. Ids in ``target`` may
    be null, repeat or be unknown; all rows of an id in it are target texts.
    Null ids are no targets. Repeated rows count as often as they stand there.
    Extra columns are not looked at.
    """
    ship_package(docs.sparkSession)
    chosen = target.select(F.col(id_col).cast("bigint").alias("doc")).filter("doc is not null").distinct().withColumn("target", F.lit(1))
    chosen = settle(chosen, "target-ids")
    # Sent to all tasks where its measured size allows that: then no text is moved.
    marked = lookup(keyed(docs, id_col, text_col), chosen, ["doc"], "left")
    own = marked.select("doc", "tag", "text", F.coalesce(F.col("target").cast("bigint"), F.lit(0).cast("bigint")).alias("target"))
    counted = own.mapInArrow(_word_counts, "hash long, n long, target long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))
    none = F.lit(0).cast("bigint")
    seen = counted.agg(F.count(F.lit(1)).alias("words"), *[F.coalesce(F.sum(c), none).alias(c) for c in ("n", "target")]).first()
    del counted
    # The shuffle of the words is done with.
    release(docs.sparkSession)
    bits = min(30, (3 * seen["n"] // PART_KEYS).bit_length())
    shift, groups = 64 - bits, seen["n"] // GROUP_TOKENS + 1

    # Both uses of the texts by group read one shuffle: they ask for the same columns, in partitions that the last join takes as they are.
    fewest = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = own.withColumn("group", F.pmod(F.xxhash64("doc", "tag"), F.lit(groups))).repartition(max(groups, fewest), "group")
    slices = "part int, group long, n int, keys binary, target binary, every binary"
    sent = texts.sortWithinPartitions("group").mapInArrow(partial(_key_counts, shift=shift), slices)
    # Some parts to a task, one after the other.
    tasks = min(max(min(1 << bits, fewest), (1 << bits) // 16), 1 << 17)
    totals = sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(partial(_totals, shift=shift), slices)
    score = partial(_score, sums=(seen["target"], seen["n"]), slots=seen["words"] + 2, shift=shift)
    scored = texts.groupBy("group").cogroup(totals.groupBy("group")).applyInArrow(
        lambda texts, slices: score(texts, slices), "doc long, tag long, n_tokens long, target_loss double, background_loss double",
    )
    return scored.select(
        given_id().alias("doc_id"), "tag", "n_tokens", "target_loss", "background_loss",
        (F.col("target_loss") - F.col("background_loss")).alias("difference"),
    )
