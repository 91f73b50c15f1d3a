"""Byte-level BPE of texts of any length by overlapping chunks.

A long text is cut into chunks at fixed places, whatever stands there, and each
chunk sees some characters of the next one. Chunks are pre-tokenised in
parallel, each from its own first character. Matching goes on alike from any
place where two chunks both have a boundary, so the first boundary that a chunk
shares with the one before it is a true one if that chunk's are; texts begin
with a true one, hence all of these are. The pieces between them are encoded in
parallel, and their ids are put together. Chunks that share no boundary (one
run of letters over the whole overlap, say) become one chunk, and are tried
again.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.llm.rows import keyed, pieces
from reviewlytics.runtime import settle, ship_package

CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 10
#: Words whose ids a worker keeps, and the longest such word: some 30 MB.
KEPT_WORDS, KEPT_CHARS = 1 << 17, 40
DECODED_ROWS = 1024

_PIECE = "doc long, tag long, row long, chunk int, ids array<int>"


class RankEncoder:
    """The ids of one rank file; ``pattern`` finds the words that merging stays within.

    The pattern must match every character, look back at none, and look one
    character ahead at most. ``\\s`` stands for Unicode white space in it.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes = pa.array(tokens, pa.binary())
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.words = regex.compile(spaces)
        self.native = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> bytes:
        """Ids (little-endian, 32 bits each) of words in turn."""
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > KEPT_WORDS:
            known.clear()
        long: dict[str, bytes] = {}
        for word in set(words).difference(known):
            # A word alone is one match again, so the library merges it whole.
            (known if len(word) <= KEPT_CHARS else long)[word] = array("I", self.native.encode_ordinary(word)).tobytes()
        if not long:
            return b"".join(map(known.__getitem__, words))
        return b"".join(known.get(w) or long[w] for w in words)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins and ends at true boundaries of its own."""
        return self.native.encode_to_numpy(text, disallowed_special=())

    def boundaries(self, text: str, final: bool) -> list[int]:
        """Where words begin if one begins at 0; a match at the end may go on, unless the text is ``final``."""
        ends = [m.end() for m in self.words.finditer(text)]
        if ends and not final:
            ends.pop()
        return [0, *ends]


@functools.lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """The encoder of a file, built once per Python worker."""
    return RankEncoder(path, pattern)


def _id_lists(encoded: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(encoded).astype(np.int32)))


def _whole(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: nothing to stitch."""
    coder = rank_encoder(path, pattern)
    for batch in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["tag"], _id_lists([coder.encode(x) for x in batch["text"].to_pylist()])], ["doc", "tag", "ids"])


def _chunks(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """A row per chunk: its place, its own characters, and those ahead of it. ``row`` tells texts apart."""
    row = TaskContext.get().partitionId() << 33
    for batch in pieces(batches):
        for doc, tag, text in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for first in range(0, len(text), size << 6):
                at = list(range(first, min(first + (size << 6), len(text)), size))
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * len(at)), pa.array([tag] * len(at)), pa.array([row] * len(at)), pa.array([a // size for a in at], pa.int32()),
                    pa.array(at), pa.array([text[a : a + size] for a in at]), pa.array([text[a + size : a + size + overlap] for a in at]),
                    pa.array([a + size >= len(text) for a in at]),
                ], ["doc", "tag", "row", "chunk", "at", "own", "ahead", "final"])
            row += 1


def _marks(batches: Iterator[pa.RecordBatch], path: str, pattern: str, overlap: int) -> Iterator[pa.RecordBatch]:
    """The boundaries that a chunk can share with its neighbours: near its first character, and ahead of its last."""
    coder = rank_encoder(path, pattern)
    for batch in pieces(batches, "own"):
        head, tail = [], []
        for at, own, ahead, final in zip(*(batch[c].to_pylist() for c in ("at", "own", "ahead", "final")), strict=True):
            found = coder.boundaries(own + ahead, final)
            head.append([at + x for x in found if x <= overlap])
            tail.append([at + x for x in found if x >= len(own)])
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch["row"], batch["chunk"], pa.array(head, lists), pa.array(tail, lists)], ["row", "chunk", "head", "tail"])


def _pieces_encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """The words of each chunk from its first true boundary to the next chunk's."""
    coder = rank_encoder(path, pattern)
    for batch in pieces(batches, "own"):
        out = []
        for at, own, ahead, since, until in zip(*(batch[c].to_pylist() for c in ("at", "own", "ahead", "since", "until")), strict=True):
            text, words = own + ahead, []
            for m in coder.words.finditer(text, since - at):
                if until is not None and m.start() >= until - at:
                    break
                words.append(m[0])
            out.append(np.frombuffer(coder.encode_words(words), "<u4"))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc", "tag", "row", "chunk")), _id_lists(out)], ["doc", "tag", "row", "chunk", "ids"])


def _merged(chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each chunk without a shared boundary put to the chunk before it."""
    order = Window.partitionBy("row").orderBy("chunk")
    groups = cuts.select("row", "chunk", F.count("since").over(order).alias("group"))
    own = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "own"))), lambda x: x["own"])
    return chunks.join(groups, ["row", "chunk"]).groupBy("row", "group").agg(
        F.first("doc").alias("doc"), F.first("tag").alias("tag"), F.min("chunk").alias("chunk"), F.min("at").alias("at"),
        F.array_join(own, "").alias("own"), F.max_by("ahead", "chunk").alias("ahead"), F.max("final").alias("final"),
    ).select(chunks.columns)


def chunked_encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc``, ``tag``, ``ids`` (array of int): every whole text encoded by the ranks in ``path``.

    ``path`` is a rank file that all executors can read, ``pattern`` as in
    RankEncoder. Texts of at most ``chunk`` characters are one chunk and stay in
    their task; the chunks of longer ones, ``overlap`` characters of look-ahead
    included, are dealt to all tasks by (text, number), and no task but the one
    that reads a long text, and the one that puts its ids together, holds the
    whole of it.

    Null and empty texts have no ids. Null ids and rows that repeat an id or a
    whole row are rows like others; extra columns are not looked at.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must lie within a chunk")
    ship_package(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    short = own.filter(F.length("text") <= chunk).mapInArrow(partial(_whole, path=path, pattern=pattern), "doc long, tag long, ids array<int>")
    shape = "doc long, tag long, row long, chunk int, at long, own string, ahead string, final boolean"
    chunks = own.filter(F.length("text") > chunk).mapInArrow(partial(_chunks, size=chunk, overlap=overlap), shape)
    chunks = settle(chunks.repartition("row", "chunk"), "chunks")
    order = Window.partitionBy("row").orderBy("chunk")
    while True:
        marks = chunks.mapInArrow(
            partial(_marks, path=path, pattern=pattern, overlap=overlap), "row long, chunk int, head array<long>, tail array<long>",
        )
        shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
        cuts = settle(marks.select("row", "chunk", F.when(F.col("chunk") == 0, F.lit(0).cast("bigint")).otherwise(shared).alias("since")), "cuts")
        if cuts.filter("since is null").isEmpty():
            break
        chunks = settle(_merged(chunks, cuts), "chunks")
    spans = cuts.withColumn("until", F.lead("since").over(order))
    encoded = chunks.join(spans, ["row", "chunk"]).mapInArrow(partial(_pieces_encoded, path=path, pattern=pattern), _PIECE)
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]))
    long = encoded.groupBy("row").agg(F.first("doc").alias("doc"), F.first("tag").alias("tag"), ids.alias("ids"))
    return short.union(long.select("doc", "tag", "ids"))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens`` with ``decoded``, binary: the bytes of its column ``ids``, one after the other. Null ids give no bytes.

    Bytes are not made into characters, so ids that end within one are decoded
    too. All other columns stay.
    """
    ship_package(tokens.sparkSession)
    shape = f"{', '.join(f'`{c}` {t}' for c, t in tokens.dtypes)}, decoded binary"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rank_encoder(path, pattern).bytes
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                size = pc.fill_null(pc.list_value_length(part["ids"]), 0)
                ends = np.cumsum(np.concatenate(([0], np.asarray(size)))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), known.take(part["ids"].flatten()))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(tokens, b"")], [*part.schema.names, "decoded"])

    return tokens.mapInArrow(joined, shape)
