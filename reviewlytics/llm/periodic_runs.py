"""Periodic runs of words, found on a suffix automaton with link-cut access.

A run is a longest stretch in which words ``period`` apart are equal. The
suffix links of a text's automaton form a tree whose paths to the root are the
prefixes' suffixes. Each word in turn gives its path the colour of its place;
before that, the path falls into segments of one older colour each, and the
deepest node of a segment is the longest common suffix of here and there. Where
that suffix is at least as long as the distance it is a square, and with the
distance added the whole repetition that ends here. A link-cut tree keeps the
segments, so all words together cross O(n log n) of them.

A word of a run of exponent k stands k times in it. So a text first falls apart
at words that stand less often within their part, again and again; this drops
no run, and most texts need no automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.rows import given_id, keyed, pieces
from reviewlytics.llm.wordhash import Words
from reviewlytics.runtime import ship_package

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SHAPE = "doc long, tag long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SuffixTree:
    """The suffix-link tree of a sequence's suffix automaton, with its paths in a link-cut tree.

    ``length`` is the longest string of a state, ``prefix`` the state of each
    prefix. Every preferred path is a splay tree ordered by depth; the colour
    of a path lies at its splay root.
    """

    def __init__(self, word: list[int]):
        step: list[dict[int, int]] = [{}]
        link, length, prefix, last = [-1], [0], [], 0
        for w in word:
            new, p = len(step), last
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p >= 0:
                q = step[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(w) == q:
                        step[p][w] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            prefix.append(new)
            last = new
        self.length, self.prefix = length, prefix
        # Up: the splay parent, or for a splay root the tree parent of its path's top.
        self.up, n = link, len(link)
        self.low, self.high, self.colour = [-1] * n, [-1] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        p = up[x]
        g = up[p]
        if low[p] == x:
            low[p] = b = high[x]
            high[x] = p
        else:
            high[p] = b = low[x]
            low[x] = p
        if b >= 0:
            up[b] = p
        up[p], up[x] = x, g
        if g >= 0:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x

    def _splay(self, x: int) -> int:
        """Make ``x`` the root of its splay tree; the colour of its path."""
        up, low, high = self.up, self.low, self.high
        root = x
        while (p := up[root]) >= 0 and (low[p] == root or high[p] == root):
            root = p
        while root != x:
            p = up[x]
            if p != root:
                self._rotate(p if (low[p] == x) == (low[up[p]] == p) else x)
            self._rotate(x)
            if p == root or up[x] < 0 or (low[up[x]] != x and high[up[x]] != x):
                break
        return self.colour[root]

    def recolour(self, i: int) -> list[tuple[int, int]]:
        """Give the path of prefix ``i`` the colour ``i``; (older colour, longest suffix that has it) of its segments."""
        up, high, colour = self.up, self.high, self.colour
        seen, below, x = [], -1, self.prefix[i]
        while x >= 0:
            old = self._splay(x)
            if old >= 0:
                seen.append((old, self.length[x]))
            if high[x] >= 0:
                colour[high[x]] = old
            high[x] = below
            below, x = x, up[x]
        colour[below] = i
        return seen


def runs_of(word: list[int], exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    tree, n, found = SuffixTree(word), len(word), []
    for i in range(n):
        for end, common in tree.recolour(i):
            period = i - end
            if common >= (exponent - 1) * period and common + period >= shortest and (i + 1 == n or word[i + 1] != word[i + 1 - period]):
                found.append((i - common - period + 1, common + period, period))
    return sorted(found)


def dense_parts(hashes: np.ndarray, first: np.ndarray, often: int, shortest: int) -> list[tuple[int, int]]:
    """The parts (from, to) of the texts in which each word stands ``often`` times or more."""
    at = np.arange(len(hashes))
    part = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name = np.unique(hashes, return_inverse=True)[1].reshape(-1)
    while len(at):
        _, back, many = np.unique(part * len(hashes) + name[at], return_inverse=True, return_counts=True)
        stay = many[back.reshape(-1)] >= often
        if stay.all():
            break
        at, part = at[stay], part[stay]
        if not len(at):
            break
        part = np.cumsum(np.concatenate(([0], (np.diff(at) != 1) | (np.diff(part) != 0))))
        stay = np.bincount(part)[part] >= shortest
        at, part = at[stay], part[stay]
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(part) != 0) + 1
    return list(zip(at[np.concatenate(([0], cuts))].tolist(), (at[np.concatenate((cuts - 1, [len(at) - 1]))] + 1).tolist(), strict=True))


def _find(batches: Iterator[pa.RecordBatch], exponent: int, shortest: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = Words(batch["text"])
        raw, start, end = words.raw, words.start, words.end
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in dense_parts(words.hash, words.first, exponent, shortest):
            names: dict[bytes, int] = {}
            word = [names.setdefault(raw[s:e].tobytes(), len(names)) for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            text = int(np.searchsorted(words.first, a, side="right")) - 1
            before = a - int(words.first[text])
            by_text.setdefault(text, []).extend((before + s, n, p) for s, n, p in runs_of(word, exponent, shortest))
        collapsed = []
        for i, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
            left = text.split()
            if runs := by_text.get(i):
                stay = np.ones(len(left), bool)
                for s, n, p in runs:
                    stay[s + p : s + n] = False
                left = [left[k] for k in np.flatnonzero(stay)]
            collapsed.append(b" ".join(left))
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in by_text.get(i, ())] for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], batch["tag"], pa.array(words.counts(), pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
            ["doc", "tag", "n_words", "runs", "collapsed"],
        )


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6,
) -> DataFrame:
    """One row per row of ``docs`` with its runs, and its text with each run cut down to one period.

    Columns: doc_id, tag (hash of the text), n_words, runs (start, length,
    period; by start, then period), collapsed (words left, joined by blanks).
    Words are separated by blanks and ``\\t \\n \\v \\f \\r``. A run is a
    stretch with a smallest period, of at least ``exponent`` periods (2 or
    more) and ``shortest`` words, that can't be longer. Runs of different
    periods may overlap; a word goes if any run holds it after that run's
    first period.

    Null, empty and blank texts have no words and no runs. Null ids, and rows
    that repeat an id or a whole row, are rows like others. Extra columns are
    not looked at. No shuffle. Memory grows with one text's longest part in
    which every word stands ``exponent`` times; other texts are handled some
    megabytes at a time. Words are told apart by their bytes; hashes decide only
    where texts fall apart.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    ship_package(docs.sparkSession)
    found = keyed(docs, id_col, text_col).mapInArrow(partial(_find, exponent=exponent, shortest=shortest), _SHAPE)
    return found.select(given_id().alias("doc_id"), "tag", "n_words", "runs", "collapsed")


def strongest(runs: str = "runs") -> Column:
    """The run of most periods; of equal ones the first, then that of the shorter period. Null where there are no runs."""
    def better(best: Column, run: Column) -> Column:
        # Runs come by start and period, so that only more periods can displace one.
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
