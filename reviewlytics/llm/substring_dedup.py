"""Removal of long word sequences that occur more than once.

A sparse de Bruijn graph of the corpus decides which windows of ``span`` words
repeat. Its vertices are sampled k-mers: the k-mer of least hash in each
window, so equal windows choose equal vertices. Its edges are compacted paths:
all windows that start from one vertex up to the next, one hash for some ten
windows. An edge that occurs twice settles all its windows at once; only
windows in edges of their own, around a repeated vertex (where the graph
branches), are compared one by one. Word positions in the source texts say
where each was found, and give the words to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.llm.rows import given_id, keyed, pieces
from reviewlytics.llm.wordhash import Words, mix, prefix_sums, run_hash, slide
from reviewlytics.runtime import ship_package

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text that a worker makes arrays of at a time: some forty times as many.
PIECE_BYTES = 1 << 20
FOUND = "key long, check int, doc long, tag long, at long, n int, sure boolean"


def _k(span: int) -> int:
    return max(1, span * 12 // 35)


class Graph:
    """Vertices and edges of the texts of one batch."""

    def __init__(self, words: Words, span: int):
        n, k = len(words.hash), _k(span)
        self.words, self.span, self.wide = words, span, span - k + 1
        self.sums, self.checks = prefix_sums(words.hash), prefix_sums(words.hash, 1)
        room = words.room()
        kmer = np.full(n, _NONE)
        kmer[: max(0, n - k + 1)] = run_hash(self.sums, np.arange(max(0, n - k + 1)), k)
        kmer[room < k] = _NONE
        self.window = np.flatnonzero(room >= span)
        #: Per word the least k-mer hash of the window that starts there; 0 where none does.
        self.least = np.zeros(n, np.uint64)
        if len(self.window):
            small = slide(kmer, self.wide, np.minimum)
            self.least[self.window] = small[self.window]
        reach = slide(np.concatenate((np.zeros(self.wide - 1, np.uint64), self.least)), self.wide, np.maximum)
        self.vertex = np.flatnonzero((reach == kmer) & (room >= k))
        self.kmer = kmer
        text = np.repeat(np.arange(len(words.first) - 1), words.counts())
        self.text = text
        #: The vertex at or before each window, in the same text; -1 where there is none.
        before = np.searchsorted(self.vertex, self.window, side="right") - 1
        ok = (before >= 0) & (text[self.vertex[before]] == text[self.window]) if len(self.vertex) else np.zeros(len(self.window), bool)
        self.before = np.where(ok, before, -1)

    def hashes(self, start: np.ndarray, n) -> tuple[np.ndarray, np.ndarray]:
        """A key and an independent check (32 bits) of the ``n`` words from ``start``."""
        check = run_hash(self.checks, start, n, 1) >> np.uint64(32)
        return run_hash(self.sums, start, n), check.astype(np.uint32).view(np.int32)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Per vertex the hashes of all words of the windows from it up to the next vertex."""
        v, ends = self.vertex, self.words.first[1:][self.text[self.vertex]]
        nxt = np.append(v[1:], 0)
        inner = np.append(self.text[v[1:]] == self.text[v[:-1]], False) if len(v) else np.zeros(0, bool)
        to = np.where(inner, np.minimum(nxt + self.span - 1, ends), ends)
        return self.hashes(v, to - v)

    def place(self, word: np.ndarray) -> np.ndarray:
        """Position of a word within its text."""
        return word - self.words.first[self.text[word]]


def _records(key, check, batch, text, at, n=None, sure=None) -> pa.RecordBatch:
    """Rows of FOUND. Of equal keys in this batch only the first needs a partner from elsewhere.

    The others are sure already; they get keys of their own (and n = 0 where
    none is given), so a key that fills the corpus meets once per batch.
    """
    if sure is None:
        #: n, where given, stays: 0 marks a witness.
        _, first, where, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        sure = count[where] > 1
        rest = sure.copy()
        rest[first] = False
    else:
        rest = sure
    doc, tag = (batch[c].to_numpy()[text] for c in ("doc", "tag"))
    key = np.where(rest, mix(doc.view(np.uint64) ^ mix(tag.view(np.uint64) + at.astype(np.uint64))), key)
    n = np.where(rest, 0, 1).astype(np.int32) if n is None else n.astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (key.view(np.int64), check, doc, tag, at.astype(np.int64), n, sure)],
        ["key", "check", "doc", "tag", "at", "n", "sure"],
    )


def _vertices(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Two rows per vertex, for its k-mer (at = 4 * place) and for its edge (4 * place + 1)."""
    for batch in pieces(batches, limit=PIECE_BYTES):
        graph = Graph(Words(batch["text"]), span)
        v = graph.vertex
        if len(v):
            at, text = 4 * graph.place(v), graph.text[v]
            (kmer, one), (edge, two) = graph.hashes(v, _k(span)), graph.edges()
            key, check = np.concatenate((kmer, edge)), np.concatenate((one, two))
            yield _records(key, check, batch, np.concatenate((text, text)), np.concatenate((at, at + 1)))


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows in repeated edges (sure), and each other window whose least k-mer repeats.

    The latter may equal a window in a repeated edge, so one text of each edge
    sends its windows too, as witnesses (n = 0).
    """
    for batch in pieces(batches, limit=PIECE_BYTES):
        graph = Graph(Words(batch["text"]), span)
        marks = batch["marks"]
        at = np.asarray(pc.list_flatten(marks))
        text = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(marks)))
        word = graph.words.first[text] + (at >> 2)
        edge, lead = np.zeros((2, len(graph.kmer) + 1), bool)
        edge[word[at % 2 == 1]] = True
        lead[word[at % 4 == 3]] = True
        again = np.unique(graph.kmer[word[at % 2 == 0]])
        window, before = graph.window, graph.before
        if not len(window):
            continue
        vertex = np.where(before >= 0, graph.vertex[before], len(graph.kmer))
        settled = edge[vertex]
        single = (~settled & np.isin(graph.least[window], again)) | lead[vertex]
        open_ = window[single]
        if len(open_):
            yield _records(*graph.hashes(open_, span), batch, graph.text[open_], graph.place(open_), ~settled[single])
        window = window[settled]
        if len(window):
            breaks = (np.diff(window) != 1) | (graph.text[window[1:]] != graph.text[window[:-1]])
            start = np.concatenate(([0], np.flatnonzero(breaks) + 1))
            run = np.diff(np.append(start, len(window)))
            start = window[start]
            none = np.zeros(len(start), np.int32)
            yield _records(graph.kmer[start], none, batch, graph.text[start], graph.place(start), run, np.ones(len(start), bool))


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose key and check (96 bits of their words) occur twice at least."""
    same = Window.partitionBy("key", "check")
    counted = rows.withColumns({"__n": F.count(F.lit(1)).over(same), "__least": F.min("doc").over(same)})
    return counted.filter((F.col("__n") > 1) | F.col("sure"))


def _cut(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Counts, the kept text and its hash per row of a batch."""
    for batch in pieces(batches, limit=PIECE_BYTES):
        words = Words(batch["text"])
        counts = words.counts()
        change = np.zeros(len(words.hash) + 1, np.int64)
        for name, value in (("starts", 1), ("ends", -1)):
            where = batch[name]
            size = np.nan_to_num(pc.fill_null(pc.list_value_length(where), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            if size.sum():
                text = np.repeat(np.arange(batch.num_rows), size)
                np.add.at(change, words.first[text] + np.asarray(pc.list_flatten(where)), value)
        gone = np.cumsum(change)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, 0).astype(np.int64), np.minimum(words.first[:-1], len(gone)))
        removed[counts == 0] = 0
        whole = words.raw.tobytes()
        shas, texts = [], []
        for i in range(batch.num_rows):
            a, b = words.first[i], words.first[i + 1]
            if removed[i]:
                keep = ~gone[a:b]
                s, e = words.start[a:b][keep], words.end[a:b][keep]
                parts = [whole[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                texts.append(b" ".join(parts).decode())
            else:
                parts = whole[words.offsets[i] : words.offsets[i + 1]].split()
                texts.append(None)
            shas.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], batch["tag"], pa.array(counts), pa.array(removed), pa.array(shas), pa.array(texts, pa.string())],
            ["doc", "tag", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 35) -> DataFrame:
    """Each text without the words of every window of ``span`` words that starts twice or more in the corpus.

    Windows lie within one text and are judged on the texts as given; both
    occurrences go. Result, one row per row of ``docs``: doc_id, tag (hash of
    the given text), n_words, n_removed, kept_sha256 (of the kept words joined
    by one blank) and kept_text (the same words; null where nothing went and
    the text stays as it is).

    1. A scan samples vertices and compacts the windows between them to edges.
       Equal k-mers and equal edges meet in one shuffle; a batch sends one row
       of each to it and marks the others itself, so no key is hot.
    2. Marks are grouped per text and joined with the texts. Windows in
       repeated edges are settled; the rest around repeated vertices meet by
       their hashes in a second, smaller shuffle.
    3. The windows found are grouped per text and joined with the texts, whose
       shuffle is reused, and the words they cover go.

    Null and blank texts have no words. Rows that repeat id and text are
    occurrences of each other, and so lose all windows. A null id is an id like
    any other and comes back null. Extra columns are not looked at.
    """
    ship_package(docs.sparkSession)
    own = keyed(docs, id_col, text_col)
    marks = _repeated(own.mapInArrow(partial(_vertices, span=span), FOUND))
    lead = F.when((F.col("n") > 0) & (F.col("doc") == F.col("__least")) & (F.col("at") % 2 == 1), 2).otherwise(0)
    marks = marks.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.col("at") + lead)).alias("marks"))
    windows = _repeated(own.join(marks.hint("merge"), ["doc", "tag"]).mapInArrow(partial(_windows, span=span), FOUND)).filter("n > 0")
    cover = windows.groupBy("doc", "tag").agg(
        F.collect_list("at").alias("starts"), F.collect_list(F.col("at") + F.col("n") + (span - 1)).alias("ends"),
    )
    shape = "doc long, tag long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    kept = own.join(cover.hint("merge"), ["doc", "tag"], "left").mapInArrow(partial(_cut, span=span), shape)
    return kept.select(given_id().alias("doc_id"), "tag", "n_words", "n_removed", "kept_sha256", "kept_text")
