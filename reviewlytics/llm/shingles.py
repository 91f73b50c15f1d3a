"""Sets of word n-grams as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from reviewlytics.llm.wordhash import Words, mix, prefix_sums, run_hash


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's begin (n + 1 values).

    A-Z are lower-cased first. A text with fewer words than ``size`` has its
    whole sequence as its one shingle; one without words has none.
    """
    words = Words(column, lower=True)
    counts = words.counts()
    sums = prefix_sums(words.hash)
    short = (counts > 0) & (counts < size)
    start = np.flatnonzero(words.room() >= size)
    hashes = np.concatenate((
        run_hash(sums, start, size),
        run_hash(sums, words.first[:-1][short], counts[short]) if short.any() else np.empty(0, np.uint64),
    ))
    owner = np.concatenate((np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0)), np.flatnonzero(short)))
    order = np.lexsort((hashes, owner)) if short.any() else _by_owner(hashes, counts - size + 1)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _by_owner(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order that sorts hashes that already lie text by text, within each text."""
    out, at = np.empty(len(hashes), np.int64), 0
    for n in np.maximum(sizes, 0):
        out[at : at + n] = at + np.argsort(hashes[at : at + n])
        at += n
    return out


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, whatever the order of their elements."""
    out = []
    for seed in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(seed)), dtype=np.uint64)))
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)))
    return out[0], out[1]
