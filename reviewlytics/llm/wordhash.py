"""Words and 64-bit hashes of word sequences, for whole Arrow batches at once.

A word is a maximal run of characters other than blank and ``\\t \\n \\v \\f \\r``.
All of these are single bytes in UTF-8, so words are found in the raw buffer of
an Arrow string column without making a Python object per word. Bytes are
handled in blocks, so a very long text costs memory in proportion to its words.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_CODE[_SPACES] = 0


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept up to the next power of two."""
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    if column.null_count:
        valid = np.asarray(column.is_valid())
        lengths = np.diff(offsets)
        if lengths[~valid].any():
            raw = raw[np.repeat(valid, lengths)]
            lengths = np.where(valid, lengths, 0)
            offsets = np.concatenate(([0], np.cumsum(lengths)))
    return raw, offsets


class Words:
    """The words of many texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.raw, self.offsets = text_buffer(column)
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(self.raw):
            to = self._cut(min(at + BLOCK_BYTES, len(self.raw)))
            s, e, h = self._block(at, to, lower)
            starts.append(s)
            ends.append(e)
            hashes.append(h)
            at = to
        none = np.empty(0, np.int64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.hash = np.concatenate(hashes) if hashes else none.astype(np.uint64)
        #: Word index at which each text begins; n + 1 values.
        self.first = np.searchsorted(self.start, self.offsets)

    def _cut(self, to: int) -> int:
        """The end of the block: the next separator or text boundary at or after ``to``."""
        while to < len(self.raw):
            k = np.searchsorted(self.offsets, to)
            boundary = self.offsets[k] if k < len(self.offsets) else len(self.raw)
            near = min(boundary, to + 4096)
            space = np.flatnonzero(_SPACES[self.raw[to:near]])
            if len(space):
                return to + int(space[0])
            if near == boundary:
                return int(boundary)
            to = near
        return len(self.raw)

    def _block(self, at: int, to: int, lower: bool):
        raw = self.raw[at:to]
        inside = ~_SPACES[raw]
        lo, hi = np.searchsorted(self.offsets, (at, to))
        cuts = np.unique(self.offsets[lo:hi]) - at
        before = np.empty(len(raw), bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        if not len(starts):
            none = np.empty(0, np.int64)
            return none, none, none.astype(np.uint64)
        after = np.empty(len(raw), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        length = ends - starts
        gaps = np.diff(np.append(starts, len(raw)))
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, gaps)
        np.minimum(place, int(length.max()), out=place)
        code = _BYTE_CODE[_LOWER[raw[starts[0] :]] if lower else raw[starts[0] :]]
        code *= powers(_WORD_BASE, int(length.max()) + 1)[place]
        sums = np.add.reduceat(code, starts - starts[0])
        return starts + at, ends + at, mix(sums + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.hash))


def spans(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` values; fewer results than values by n - 1."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    return run_hash(prefix_sums(hashes, seed), np.arange(len(hashes) - n + 1), n, seed)


def _base(seed: int) -> int:
    return (0xC2B2AE3D27D4EB4F + 8 * seed * 0x165667B19E3779F9) & _MASK | 3


def prefix_sums(hashes: np.ndarray, seed: int = 0) -> np.ndarray:
    terms = mix(hashes + np.uint64((seed * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) & _MASK))
    terms *= powers(_base(seed), len(hashes))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))


def run_hash(sums: np.ndarray, start: np.ndarray, n, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` values from ``start``; equal runs have equal hashes wherever they stand."""
    inverse = pow(_base(seed), -1, 1 << 64)
    x = (sums[start + n] - sums[start]) * powers(inverse, len(sums))[start]
    return mix(x + np.asarray(n, np.uint64) * np.uint64(0x9FB21C651E98DF25))


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out
