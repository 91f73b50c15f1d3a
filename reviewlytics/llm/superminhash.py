"""SuperMinHash signatures (Ertl, 2017) of many sets at once.

Each element visits the m slots in an order of its own, a permutation drawn
step by step, and offers slot p_j the value j + u_j with u_j uniform in [0, 1).
A slot keeps its least offer. Ranks of one element are correlated (a
permutation, no independent draws), which lowers the variance of the estimate.

All elements take step j together. A set whose slots all hold less than j + 1
can't change any more and leaves: the early stop. A set of many more elements
than slots leaves after one step.
"""

from __future__ import annotations

import numpy as np

from reviewlytics.llm.wordhash import mix

CHUNK = 1 << 15


def signatures(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` 64-bit values per set; sets are ``elements[first[i]:first[i + 1]]``.

    Two sets agree in a slot with the probability of their Jaccard similarity.
    An empty set has a row of zeros.
    """
    sizes = np.diff(first)
    best = np.full(len(sizes) * slots, np.inf)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _step(elements, owner, 0, None, best, slots)
    full = best.reshape(-1, slots).max(axis=1) < 1 if len(sizes) else np.empty(0, bool)
    late = np.flatnonzero(~full[owner])
    bounds = _cuts(owner[late])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        _finish(elements[late[lo:hi]], owner[late[lo:hi]], best, slots)
    best = best.reshape(-1, slots)
    best[sizes == 0] = 0
    return mix(best.view(np.uint64) + np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _cuts(owner: np.ndarray) -> list[int]:
    """Bounds of chunks of about CHUNK elements that keep each set whole."""
    out = [0]
    while out[-1] < len(owner):
        to = min(out[-1] + CHUNK, len(owner))
        if to < len(owner):
            to = int(np.searchsorted(owner, owner[to], "left"))
            if to == out[-1]:
                to = int(np.searchsorted(owner, owner[to], "right"))
        out.append(to)
    return out


def _step(elements, owner, j, order, best, slots) -> None:
    draw = mix(elements + np.uint64((j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    place = j + ((draw >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
    offer = j + (draw & np.uint64((1 << 40) - 1)).astype(np.float64) / (1 << 40)
    if order is not None:
        rows = np.arange(len(elements))
        chosen = order[rows, place].astype(np.int64)
        order[rows, place] = order[:, j]
        place = chosen
    np.minimum.at(best, owner * slots + place, offer)


def _finish(elements, owner, best, slots) -> None:
    """Steps 0, 1, 2, ... of sets that need more than one; step 0 is repeated for its swap."""
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    for j in range(slots):
        _step(elements, owner, j, order, best, slots)
        sets = np.unique(owner)
        done = best.reshape(-1, slots)[sets].max(axis=1) < j + 1
        if done.any():
            stay = ~done[np.searchsorted(sets, owner)]
            elements, owner, order = elements[stay], owner[stay], order[stay]
            if not len(elements):
                return


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of consecutive slots; keys of different bands differ."""
    rows = signature.shape[1] // bands
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), parts.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * np.uint64(0xE7037ED1A0B428DB) + parts[:, :, r])
    return keys
