"""Token ids in files of wavelet matrices: succinct, and searchable without unpacking."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlytics.llm.bpe import encoded, library_encoder
from reviewlytics.llm.rows import given_id, keyed, pieces
from reviewlytics.runtime import scratch_folder, ship_package

MAGIC = b"WVM1"
RANK_BITS = 512
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sIQ")


def _cell(depth: int) -> type:
    """The number type of ids of so many bits while they move through the planes."""
    return np.uint16 if depth <= 16 else np.uint32


class WaveletMatrix:
    """A sequence of ids as one bit-plane per bit, highest first, each with the ones counted every RANK_BITS bits.

    A plane holds one bit of each id, in the order that the planes above have
    made: ids with a zero bit come before those with a one bit, otherwise as
    they were. So an id's way through the planes is a chain of rank queries.

    Format, little-endian: magic, number of planes, number of ids; then per
    plane its zeros (8 bytes), its rank table (4 bytes each) and its bits,
    filled up to RANK_BITS.
    """

    def __init__(self, data: bytes):
        magic, self.depth, self.size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        blocks = self.size // RANK_BITS + 1
        at = _HEAD.size
        self.zeros, self.table, self.bits = [], [], []
        for _ in range(self.depth):
            self.zeros.append(int.from_bytes(data[at : at + 8], "little"))
            self.table.append(np.frombuffer(data, "<u4", blocks, at + 8))
            self.bits.append(np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + blocks * RANK_BITS // 8

    @staticmethod
    def build(ids: np.ndarray, depth: int) -> bytes:
        size, blocks = len(ids), len(ids) // RANK_BITS + 1
        out, now = [_HEAD.pack(MAGIC, depth, size)], np.asarray(ids, _cell(depth))
        for level in range(depth - 1, -1, -1):
            one = now & now.dtype.type(1 << level) != 0
            bits = np.zeros(blocks * RANK_BITS // 8, np.uint8)
            bits[: -(-size // 8)] = np.packbits(one)
            ones = np.bitwise_count(bits.view(np.uint64)).reshape(blocks, -1).sum(axis=1, dtype=np.int64)
            table = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")
            zeros = size - int(ones.sum())
            after = np.empty_like(now)
            after[zeros:] = now[one]
            after[:zeros] = now[np.logical_not(one, out=one)]
            now = after
            out += [zeros.to_bytes(8, "little"), table.tobytes(), bits.tobytes()]
        return b"".join(out)

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, RANK_BITS)
        at = block * RANK_BITS // 8
        part = self.bits[plane][at : at + -(-rest // 8)]
        return int(self.table[plane][block]) + int(np.unpackbits(part)[:rest].sum())

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def __getitem__(self, i: int) -> int:
        value = 0
        for plane in range(self.depth):
            bit, ones = self._bit(plane, i), self._rank(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before ``end`` lie below the last plane."""
        lo, hi = 0, end
        for plane in range(self.depth):
            a, b = self._rank(plane, lo), self._rank(plane, hi)
            if token >> (self.depth - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before position ``end``."""
        if token >> self.depth:
            return 0
        lo, hi = self._range(token, self.size if end is None else end)
        return hi - lo

    def find(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.size)[0] + k
        for plane in range(self.depth - 1, -1, -1):
            one = token >> (self.depth - 1 - plane) & 1
            i = self._select(plane, i - self.zeros[plane] if one else i, one)
        return i

    def _select(self, plane: int, k: int, one: int) -> int:
        """Position of the zero or one number ``k`` of a plane."""
        lo, hi, table = 0, len(self.table[plane]) - 1, self.table[plane]
        while lo < hi:
            mid = (lo + hi + 1) // 2
            before = int(table[mid]) if one else mid * RANK_BITS - int(table[mid])
            lo, hi = (mid, hi) if before <= k else (lo, mid - 1)
        before = int(table[lo]) if one else lo * RANK_BITS - int(table[lo])
        bits = np.unpackbits(self.bits[plane][lo * RANK_BITS // 8 : (lo + 1) * RANK_BITS // 8])
        return lo * RANK_BITS + int(np.flatnonzero(bits == one)[k - before])

    def ids(self) -> np.ndarray:
        """All ids in their order: from the lowest plane up, each undoes its partition."""
        now = np.zeros(self.size, _cell(self.depth))
        for plane in range(self.depth - 1, -1, -1):
            one, zeros = np.unpackbits(self.bits[plane], count=self.size).view(bool), self.zeros[plane]
            now[zeros:] |= now.dtype.type(1 << (self.depth - 1 - plane))
            up = np.empty_like(now)
            up[one] = now[zeros:]
            up[np.logical_not(one, out=one)] = now[:zeros]
            now = up
        return now.astype(np.uint32)


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 2, shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode all texts, each with ``end_id`` after it, and write shards in ascending doc_id order to ``path``.

    A shard is one row of a Parquet file (compressed by zstd): part, shard,
    docs, tags and sizes of its texts, and their ids as a wavelet matrix. It is
    closed after the text that fills it. Order: part, then shard. Null and
    empty texts hold the end id alone; rows without an id come first; rows that
    repeat an id stand side by side. Extra columns are not looked at.
    """
    ship_package(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = library_encoder(tokenizer), TaskContext.get().partitionId()
        depth = max(coder.size - 1, end_id).bit_length()
        number, held, have = 0, [], 0

        def close() -> pa.RecordBatch:
            docs, tags, ids = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
                pa.array([tags], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
                pa.array([have], pa.int64()), pa.array([WaveletMatrix.build(np.concatenate(ids), depth)], pa.binary()),
            ], ["part", "shard", "docs", "tags", "sizes", "n_tokens", "matrix"])

        for batch in pieces(batches):
            for doc, tag, ids in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), encoded(batch, coder), strict=True):
                held.append((doc, tag, np.append(ids, np.uint32(end_id))))
                have += len(ids) + 1
                if have >= shard_tokens:
                    yield close()
                    number, held, have = number + 1, [], 0
        if held:
            yield close()

    shape = "part int, shard int, docs array<long>, tags array<long>, sizes array<int>, n_tokens long, matrix binary"
    ordered = keyed(docs, id_col, text_col).repartitionByRange("doc", "tag").sortWithinPartitions("doc", "tag")
    ordered.mapInArrow(shards, shape).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per text, from the files: doc_id, tag, start (ids before it in all files), n_tokens, ids_crc32 (unsigned, little-endian 32-bit ids).

    Texts that were null or empty hold the end id alone; rows without an id have
    a null one; repeated rows are rows like others; files of an empty table
    give no rows.
    """
    ship_package(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix(row["matrix"]).ids().astype("<u4")
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["docs"]), pa.array(row["tags"]), pa.array(starts), pa.array(row["sizes"], pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc", "tag", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(
        "part int, shard int, docs array<long>, tags array<long>, sizes array<int>, n_tokens long, matrix binary"
    ).parquet(path)
    # One row per part, then one per shard of a part: offsets never meet in one task.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part")
    texts = files.mapInArrow(unpack, "part int, shard int, doc long, tag long, at long, n_tokens long, ids_crc32 long")
    return texts.join(starts, ["part", "shard"]).select(
        given_id().alias("doc_id"), "tag", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
    )


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return f"{scratch_folder(spark).rstrip('/')}/tokens/{uuid.uuid4().hex}"
