"""Penalised linear models, many at a time: trust-region Newton over shared vectors.

Folds, costs and nested folds are fits of one problem. Their weights are the
columns of one matrix, and every pass over the vectors serves all of them: each
document's margins under all fits, then one sum of gradients, or of Hessian
products, of all fits. A document is stored once, with the training sets that it
belongs to and those that it is held out for.

A training set's vocabulary, frequencies and Naive Bayes ratio come from its own
documents. They are a scale per term and a length per document beside the shared
counts.

Sets that a task can go through by itself are dealt to the tasks, one each, which
takes no pass of all tasks per product: a task keeps its set's counts in a file
and reads them block by block. Larger sets are summed by all tasks together. Both
run the same steps.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.operators import features as feat
from reviewlytics.operators.naive_bayes import ONE_CLASS
from reviewlytics.operators.ranking import SCORE_DIGITS
from reviewlytics.runtime import arrow_batches, release, settle, ship_package

#: Nonzero counts in a block of documents; a pass holds a few numbers per count at a time.
BLOCK_COUNTS = 1 << 18
#: A block of at least so many counts ends where other training sets begin; so many are put in order at a time.
LEAST_COUNTS, SORTED_COUNTS = 1 << 16, 1 << 21
#: A fit is done when its gradient is this small beside the one at zero.
TOLERANCE = 1e-7
#: Weights of one pass: more fits than fit in here take turns. The driver holds some ten times as much meanwhile.
PASS_BYTES = 16 * 1024 * 1024
#: Bytes of documents that a worker is handed at a time.
BATCH_BYTES = 8 * 1024 * 1024
#: Larger sums are added up in slices of so many bytes, spread over the executors; sums of all partitions below it go straight to the driver.
SLICE_BYTES = 1 << 20
#: Files of finished passes are deleted once this much has been shuffled.
RELEASE_BYTES = 4 << 30
#: Sets of at most so many counts for each core that has one are fitted by a task each. Counts that are sent to it, and that it reads, at a time.
OWN_COUNTS, SENT_COUNTS, READ_COUNTS = 1 << 25, 1 << 16, 1 << 20
#: Up to so many training sets terms are counted for all of them in one row; up to FEW_SETS straight from the documents.
MANY_SETS, FEW_SETS = 32, 8


@dataclass
class Block:
    """Some documents, those of the same training sets side by side: their counts by row, and their lengths under each set that one of them is in or held out for.

    ``value`` is empty where all counts are 1.
    """

    label: np.ndarray
    part: np.ndarray
    trains: np.ndarray
    held: np.ndarray
    size: np.ndarray
    term: np.ndarray
    value: np.ndarray
    length: dict[int, np.ndarray] = field(default_factory=dict)
    number: int = 0

    def __post_init__(self):
        self.trains, self.held = (x.reshape(len(self.label), -1) for x in (self.trains, self.held))

    def ready(self) -> Block:
        """What every sum reads, made from the stored counts."""
        self.term = self.term.astype(np.intp)
        self.full = np.flatnonzero(self.size)
        self.start = (np.cumsum(self.size) - self.size)[self.full]
        return self

    def measure(self, squares: np.ndarray, normalise: bool) -> Block:
        """Set the lengths; ``squares``: each term's squared idf under each training set (rows), 0 where it is unknown."""
        for i in np.flatnonzero((self.trains | self.held).any(axis=0)).tolist():
            length = np.sqrt(self.times(squares[i], self.value * self.value)) if normalise else np.ones(len(self.label))
            self.length[i] = np.where(length > 0, length, 1.0)
        return self

    def times(self, vector: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
        """Counts (documents x terms), or other values in their places, times ``vector``."""
        value = self.value if value is None else value
        out = np.zeros(len(self.label))
        if len(self.full):
            at = vector.take(self.term)
            out[self.full] = np.add.reduceat(at * value if len(value) else at, self.start)
        return out

    def transposed(self, rows: np.ndarray, terms: int, square: bool = False) -> np.ndarray:
        """(Terms x documents) times ``rows``."""
        weight = np.repeat(rows, self.size)
        if len(self.value):
            weight *= self.value * self.value if square else self.value
        return np.bincount(self.term, weight, terms)


def _losses(kind: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, and its first and second derivative by the margin."""
    z = y * margin
    if kind == "squared_hinge":
        gap = np.maximum(0.0, 1.0 - z)
        return gap * gap, -2.0 * y * gap, 2.0 * (gap > 0)
    p = 1.0 / (1.0 + np.exp(np.minimum(z, 700.0)))
    return np.logaddexp(0.0, -z), -y * p, p * (1.0 - p)


def _logistic(margin: np.ndarray) -> np.ndarray:
    """Scores, with the digits that all scores keep."""
    return np.round(1.0 / (1.0 + np.exp(-np.maximum(margin, -700.0))), SCORE_DIGITS)


def _margins(block: Block, state: dict, fit: int) -> np.ndarray:
    return block.times(state["weights"][fit]) / block.length[int(state["sets"][fit])] + state["bias"][fit]


def _members_of(block: Block, state: dict, which: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each fit, its training set, and which documents of the block are in (or held out for) that; fits of none are left out."""
    member = getattr(block, which)
    some = member.any(axis=0)
    for fit, own in enumerate(state["sets"].tolist()):
        if some[own]:
            yield fit, own, member[:, own]


def _gradient(block: Block, state: dict, out: list[np.ndarray]) -> None:
    """Sums of losses, gradients and diagonal second derivatives (terms, then the intercept)."""
    terms, y = state["weights"].shape[1], block.label * 2.0 - 1.0
    for fit, own, mask in _members_of(block, state, "trains"):
        loss, one, two = (x * mask for x in _losses(state["kind"], y, _margins(block, state, fit)))
        length = block.length[own]
        out[0][fit] += loss.sum()
        out[1][fit, :-1] += block.transposed(one / length, terms)
        out[1][fit, -1] += one.sum()
        out[2][fit, :-1] += block.transposed(two / length**2, terms, square=True)
        out[2][fit, -1] += two.sum()


def _product(block: Block, state: dict, out: list[np.ndarray]) -> None:
    """The Hessian of the losses times a direction of each fit (terms, then the intercept)."""
    terms, y = state["weights"].shape[1], block.label * 2.0 - 1.0
    row = dict(zip(state["live"].tolist(), range(len(state["live"])), strict=True))
    for fit, own, mask in _members_of(block, state, "trains"):
        if fit in row:
            i, length = row[fit], block.length[own]
            two = state["two"][block.number][fit] if "two" in state else _losses(state["kind"], y, _margins(block, state, fit))[2]
            along = two * mask * (block.times(state["step"][i, :-1]) / length + state["step"][i, -1])
            out[0][i, :-1] += block.transposed(along / length, terms)
            out[0][i, -1] += along.sum()


def _class_sums(block: Block, state: dict, out: list[np.ndarray]) -> None:
    """Scaled counts, and numbers, of each training set's positive and negative documents."""
    for _, own, mask in _members_of(block, state, "trains"):
        for i, label in enumerate((1, 0)):
            rows = mask * (block.label == label)
            out[i][own] += block.transposed(rows / block.length[own], out[i].shape[1])
            out[2 + i][own] += rows.sum()


def _hits(block: Block, state: dict, out: list[np.ndarray]) -> None:
    """Right predictions and documents of each part and fit, among those held out for its training set."""
    for fit, _, mask in _members_of(block, state, "held"):
        mask = mask.astype(bool)
        right = (_logistic(_margins(block, state, fit)) >= 0.5) == (block.label == 1)
        out[0][:, fit] += np.bincount(block.part[mask & right], minlength=len(out[0]))
        out[1][:, fit] += np.bincount(block.part[mask], minlength=len(out[1]))


_STORED = {"label": np.int8, "part": np.int32, "trains": np.uint8, "held": np.uint8, "size": np.int64, "term": np.int32, "value": np.float64}


def _over_blocks(blocks: Iterator[Block], step, state, more, shapes: list[tuple]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """The sums of a task as slices, each named by its array and place."""
    state, out = state.value | (more.value if more else {}), None
    for block in blocks:
        out = out or [np.zeros(x) for x in shapes]
        step(block.ready(), state, out)
    n = max(1, SLICE_BYTES // 8)
    for i, x in enumerate(out or []):
        flat = x.reshape(-1)
        for at in range(0, len(flat), n):
            yield (i, at), flat[at : at + n]


def _members(lists: pa.Array, n_sets: int) -> np.ndarray:
    """One byte per document and set: whether the set is in the document's list."""
    out = np.zeros((len(lists), n_sets), np.uint8)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), size), np.asarray(lists.flatten())] = 1
    return out


def _decoded(batch: pa.RecordBatch, known: pa.Array, options: feat.VectorOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known terms of a batch's documents as numbers: how many each document has, the terms, and their values (none where all are 1)."""
    lists = batch["terms"]
    flat = lists.flatten()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    term = pc.index_in(flat.field("term"), value_set=known)
    found = np.asarray(term.is_valid())
    end = np.concatenate(([0], np.cumsum(found)))[np.cumsum(size)]
    value = np.empty(0)
    if not options.binary:
        tf = np.asarray(flat.field("tf").cast(pa.float64()))[found]
        value = 1.0 + np.log(tf) if options.sublinear_tf else tf
    return np.diff(end, prepend=0), np.asarray(term.drop_null(), np.int32), value


def _in_order(member: np.ndarray, size: np.ndarray, term: np.ndarray, value: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents with those of equal ``member`` rows side by side, BLOCK_COUNTS or one document at a time: (documents, sizes, terms, values).

    A block ends where other rows begin if it has ``least`` counts.
    """
    group = np.unique(member, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(group, kind="stable")
    start, new, group = np.cumsum(size) - size, size[order], group[order]
    end, at = np.cumsum(new), 0
    for to in np.append(np.flatnonzero(np.diff(group)) + 1, len(group)).tolist():
        while at < to:
            before = int(end[at] - new[at])
            stop = max(at + 1, int(np.searchsorted(end, before + BLOCK_COUNTS, side="right")))
            if stop >= to and to < len(group) and end[to - 1] - before < least:
                break
            stop = min(stop, to)
            some = order[at:stop]
            where = np.arange(end[stop - 1] - before) + np.repeat(start[some] - (end[at:stop] - new[at:stop] - before), new[at:stop])
            yield some, new[at:stop], term[where], value[where] if len(value) else value
            at = stop


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary, options: feat.VectorOptions, n_sets: int) -> Iterator[pa.RecordBatch]:
    held_back, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        label, place, trains, held, size, term, value = (np.concatenate(x) for x in zip(*held_back, strict=True))
        held_back.clear()
        for some, *counts in _in_order(np.concatenate((trains, held), axis=1), size, term, value, LEAST_COUNTS):
            parts = (label[some], place[some], trains[some], held[some], *counts)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(parts, _STORED.values(), strict=True)], list(_STORED))

    for batch in batches:
        if batch.num_rows:
            label, place = np.asarray(batch["label"], np.int8), np.asarray(batch["slice"], np.int32)
            trains, held = (_members(batch[c], n_sets) for c in ("trains", "held"))
            counts = _decoded(batch, vocabulary.value, options)
            held_back.append((label, place, trains, held, *counts))
            n += len(counts[1])
            if n >= SORTED_COUNTS:
                yield from flush()
                n = 0
    if held_back:
        yield from flush()


def _scores(batches: Iterator[pa.RecordBatch], vocabulary, squares, state, options: feat.VectorOptions, n_sets: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The scores of held-out documents, under all fits of their sets at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = _members(batch["held"], n_sets)
        for some, size, term, value in _in_order(held, *_decoded(batch, vocabulary.value, options), least=0):
            none = np.zeros(len(some), np.int8)
            block = Block(none, none, held[some], held[some], size, term, value).ready().measure(squares.value, options.normalise)
            for fit, _, mask in _members_of(block, state.value, "held"):
                row = np.flatnonzero(mask)
                columns = [batch[c].take(pa.array(some[row])) for c in keep]
                score = _logistic(_margins(block, state.value, fit)[row])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(row), fit, np.int32)), pa.array(score)], [*keep, "number", "score"])


def _read_block(row, squares, normalise: bool) -> Block:
    block = Block(*(np.frombuffer(bytes(x), kind) for x, kind in zip(row, _STORED.values(), strict=True)))
    term = block.term
    block.ready().measure(squares.value, normalise)
    return Block(block.label, block.part, block.trains, block.held, block.size, term, block.value, block.length)


@dataclass
class Fit:
    """One model to be fitted: on which training set, at what cost; and, once done, how."""

    train: int
    cost: float
    weights: np.ndarray | None = None
    bias: float = 0.0
    loss: float = np.nan
    gradient: float = np.nan
    gradient_at_zero: float = np.nan
    newton_steps: int = 0
    products: int = 0
    accuracy: float = np.nan
    converged: bool = False
    n_docs: int = 0
    n_features: int = 0


class Newton:
    """Many fits at once by trust-region Newton steps, from sums over documents.

    ``scale`` has a row per training set. :meth:`_sum` makes the sums of one
    pass, :meth:`_send` hands over what several passes read.
    """

    scale: np.ndarray

    def _sum(self, step, state: dict, shapes: list[tuple], base=None) -> list[np.ndarray]:
        raise NotImplementedError

    def _send(self, state: dict):
        raise NotImplementedError

    def _state(self, kind: str, fits: list[Fit], theta: np.ndarray) -> dict:
        """``theta``: a row per fit, its weights and then its intercept."""
        sets = np.array([f.train for f in fits])
        weights = self.scale[sets]
        weights *= theta[:, :-1]
        return {"kind": kind, "sets": sets, "weights": weights, "bias": theta[:, -1].copy()}

    def _own(self, fit: Fit) -> np.ndarray:
        """What a fit's terms, and the intercept, are scaled by."""
        return np.append(self.scale[fit.train], 1.0)

    def _newton(self, kind: str, fits: list[Fit], tolerance: float, first: np.ndarray | None = None) -> None:
        """``first``: where to begin, a row per fit; at zero unless given."""
        cost = np.array([f.cost for f in fits])
        shape = len(fits), self.scale.shape[1] + 1

        def evaluate(theta: np.ndarray, some: np.ndarray):
            """Value, gradient and root of the Hessian's diagonal of each fit."""
            loss, gradient, root = self._sum(_gradient, self._state(kind, [fits[i] for i in some], theta), [(len(some),), theta.shape, theta.shape])
            for i, at, g, h in zip(some, theta, gradient, root, strict=True):
                own = self._own(fits[i])
                g *= cost[i] * own
                g += at
                h *= cost[i] * own * own
                h += 1.0
                np.sqrt(h, out=h)
            return 0.5 * np.einsum("ij,ij->i", theta, theta) + cost[some] * loss, gradient, root

        norm = partial(np.linalg.norm, axis=1)
        every = np.arange(len(fits))
        theta = np.zeros(shape)
        value, gradient, root = evaluate(theta, every)
        at_zero = norm(gradient)
        if first is not None:
            theta = first
            value, gradient, root = evaluate(theta, every)
        radius = np.array([np.linalg.norm(g / h) for g, h in zip(gradient, root, strict=True)])
        active = np.flatnonzero(at_zero > 0)
        for i in every:
            fits[i].gradient_at_zero = float(at_zero[i])
        now = norm(gradient)
        active = active[now[active] > tolerance * at_zero[active]]
        while len(active):
            share = np.minimum(0.1, np.sqrt(now[active] / at_zero[active]))
            new, length, gain, edge, products = self._steihaug(
                self._state(kind, [fits[i] for i in active], theta[active]), [fits[i] for i in active], gradient, root, active, radius[active], share,
            )
            new += theta[active]
            new_value, new_gradient, new_root = evaluate(new, active)
            new_now = norm(new_gradient)
            ratio = (value[active] - new_value) / np.maximum(gain, 1e-300)
            # So near the least value the difference is lost in rounding; the gradient is not.
            level = gain <= 1e-9 * np.abs(value[active])
            better = np.where(level, new_now < now[active], ratio > 1e-4)
            radius[active] = np.where(
                better & (level | (ratio > 0.25)), np.where(edge & (ratio > 0.75), 2.0 * radius[active], radius[active]), 0.25 * np.minimum(length, radius[active]),
            )
            for at in np.flatnonzero(better).tolist():
                i = active[at]
                theta[i], gradient[i], root[i], value[i], now[i] = new[at], new_gradient[at], new_root[at], new_value[at], new_now[at]
            del new, new_gradient, new_root
            for i, n in zip(active, products, strict=True):
                fits[i].newton_steps += 1
                fits[i].products += int(n)
            active = active[(now[active] > tolerance * at_zero[active]) & (radius[active] > 1e-14 * np.maximum(norm(theta[active]), 1.0))]
        for i, f in enumerate(fits):
            f.weights, f.bias, f.loss, f.gradient = theta[i, :-1].copy(), float(theta[i, -1]), float(value[i]), float(now[i])
            f.converged = bool(now[i] <= tolerance * at_zero[i])

    def _steihaug(self, state: dict, fits: list[Fit], gradient, root, active, radius, share):
        """Conjugate gradients on the quadratic model of each fit, in units of ``root``, within ``radius``.

        ``gradient`` and ``root`` have rows for other fits too; ``active`` are
        those of ``fits``. Gives the steps, their lengths in those units, what
        the model gains, whether a step ends at the edge, and the products.
        The weights are sent to the workers once, then only directions are.
        """
        n, shape = len(fits), (len(fits), gradient.shape[1])
        s, r = np.zeros(shape), np.empty(shape)
        for x, i in zip(r, active, strict=True):
            np.divide(gradient[i], root[i], out=x)
            x *= -1.0
        d, rr = r.copy(), np.einsum("ij,ij->i", r, r)
        stop, edge, products = share * np.sqrt(rr), np.zeros(n, bool), np.zeros(n, int)
        live = np.flatnonzero(rr > 0)
        base = self._send(state)
        del state
        try:
            while len(live):
                step = np.empty((len(live), shape[1]))
                for x, i in zip(step, live, strict=True):
                    np.divide(d[i], root[active[i]], out=x)
                    x *= self._own(fits[i])
                product, = self._sum(_product, {"live": live, "step": step}, [step.shape], base)
                del step
                on = []
                for hd, i in zip(product, live.tolist(), strict=True):
                    own_root = root[active[i]]
                    hd *= fits[i].cost * self._own(fits[i])
                    hd += d[i] / own_root
                    hd /= own_root
                    products[i] += 1
                    dd, ds, ss = d[i] @ d[i], d[i] @ s[i], s[i] @ s[i]
                    alpha = rr[i] / (d[i] @ hd)
                    edge[i] = ss + 2.0 * alpha * ds + alpha**2 * dd > radius[i] ** 2
                    if edge[i]:
                        alpha = (-ds + np.sqrt(max(ds**2 + dd * (radius[i] ** 2 - ss), 0.0))) / dd
                    s[i] += alpha * d[i]
                    hd *= alpha
                    r[i] -= hd
                    fresh = r[i] @ r[i]
                    d[i] *= fresh / rr[i]
                    d[i] += r[i]
                    rr[i] = fresh
                    on.append(not edge[i] and np.sqrt(fresh) > stop[i])
                del product
                live = live[np.array(on)]
        finally:
            base.destroy()
        # What is left of the residual tells the Hessian's product with the whole step.
        gain, length = np.empty(n), np.linalg.norm(s, axis=1)
        for x, (i, k) in enumerate(zip(active, range(n), strict=True)):
            gain[x] = 0.5 * (s[k] @ (r[k] - gradient[i] / root[i]))
            s[k] /= root[i]
        return s, length, gain, edge, products


@dataclass
class _Kept:
    """A state that stays where it is."""

    value: dict

    def destroy(self) -> None:
        pass


def _rows_of(block: Block, which: str, own: int) -> Iterator[tuple]:
    """The block's documents that are in (or held out for) a set, some at a time: label, size, length, term, value."""
    mask = getattr(block, which)[:, own].astype(bool)
    if not mask.any():
        return
    label, size, length, term, value = block.label[mask], block.size[mask], block.length[own][mask], block.term, block.value
    if not mask.all():
        inside = np.repeat(mask, block.size)
        term, value = term[inside], value[inside] if len(value) else value
    end, at = np.cumsum(size), 0
    while at < len(size):
        before = int(end[at] - size[at])
        to = max(at + 1, int(np.searchsorted(end, before + SENT_COUNTS, side="right")))
        counts = slice(before, int(end[to - 1]))
        yield label[at:to], size[at:to], length[at:to], term[counts].astype(np.int32), value[counts] if len(value) else value
        at = to


def _dealt(block: Block, sets: list[int], judge: bool) -> Iterator[tuple[int, tuple]]:
    """The block's rows for each set, by its place in ``sets``: those it is fitted on and, to judge, those held out for it."""
    for i, own in enumerate(sets):
        for which in ("trains", "held") if judge else ("trains",):
            for rows in _rows_of(block, which, own):
                yield i, (which, rows)


class OwnSet(Newton):
    """One training set in one task: the counts lie in a nameless file and are read READ_COUNTS or one document at a time.

    Terms are numbered anew, so vectors are as long as the set's own vocabulary.
    """

    def __init__(self, rows: Iterator[tuple[str, tuple]], scale: np.ndarray):
        self.known = np.flatnonzero(scale)
        self.scale, self.n_all = scale[self.known][None], len(scale)
        self._number = np.full(self.n_all, -1, np.int32)
        self._number[self.known] = np.arange(len(self.known), dtype=np.int32)
        self._file, self._stored, waiting = tempfile.TemporaryFile(), {"trains": [], "held": []}, {"trains": [], "held": []}
        for which, row in rows:
            waiting[which].append(row)
            if sum(len(r[3]) for r in waiting[which]) >= READ_COUNTS:
                self._store(which, waiting[which])
        for which, left in waiting.items():
            if left:
                self._store(which, left)

    def _store(self, which: str, rows: list[tuple]) -> None:
        label, size, length, term, value = (np.concatenate(x) for x in zip(*rows, strict=True))
        rows.clear()
        term = self._number.take(term)
        known = term >= 0
        start = np.cumsum(size) - size
        size = np.add.reduceat(np.append(known, False), start, dtype=np.int64) * (size > 0)
        levels = code = np.empty(0)
        if len(value):
            levels, code = np.unique(value[known], return_inverse=True)
            code = code.astype(np.min_scalar_type(max(len(levels) - 1, 0)))
        at = self._file.seek(0, 2)
        self._file.write(term[known].tobytes())
        self._file.write(code.tobytes())
        self._stored[which].append((at, code.dtype, levels, label, size, length))

    def _blocks(self, which: str) -> Iterator[Block]:
        for number, (at, kind, levels, label, size, length) in enumerate(self._stored[which]):
            n, member = int(size.sum()), np.ones(len(label), np.uint8)
            self._file.seek(at)
            term = np.frombuffer(self._file.read(4 * n), np.int32)
            value = levels.take(np.frombuffer(self._file.read(kind.itemsize * n), kind)) if len(levels) else levels
            yield Block(label, np.zeros(len(label), np.int32), member, member, size, term, value, {0: length}, number).ready()

    def _sum(self, step, state: dict, shapes: list[tuple], base: _Kept | None = None) -> list[np.ndarray]:
        out = [np.zeros(x) for x in shapes]
        state = state | (base.value if base else {})
        for block in self._blocks("held" if step is _hits else "trains"):
            step(block, state, out)
        return out

    def _send(self, state: dict) -> _Kept:
        """The second derivatives are the same in all products of a Newton step."""
        fits = range(len(state["sets"]))
        two = [
            [_losses(state["kind"], block.label * 2.0 - 1.0, _margins(block, state, fit))[2] for fit in fits] for block in self._blocks("trains")
        ]
        return _Kept(state | {"two": two})

    def minimise(self, kind: str, fits: list[Fit], tolerance: float, judge: bool) -> None:
        """Fit one after another, each from the one before; with ``judge`` give the accuracy on what is held out, without the weights."""
        theta = None
        for f in sorted(fits, key=lambda f: f.cost):
            self._newton(kind, [f], tolerance, theta)
            theta = np.append(f.weights, f.bias)[None]
            if judge:
                shape = 1, 1
                right, n = self._sum(_hits, self._state(kind, [f], theta), [shape, shape])
                f.accuracy, f.weights = float(right[0, 0] / max(n[0, 0], 1)), None
            else:
                f.weights, own = np.zeros(self.n_all), f.weights
                f.weights[self.known] = own


def _fit_own(rows: Iterator[tuple[int, tuple]], scale, fits, kind: str, tolerance: float, judge: bool) -> Iterator[tuple[int, Fit]]:
    """A task's set with all its fits: their places in the whole list, and what became of them."""
    first = next(rows, None)
    if first is None:
        return
    place, row = first
    own, of_set = fits.value[place]
    vectors = OwnSet(chain([row], (r for _, r in rows)), scale.value[own])
    some = [Fit(0, cost) for _, cost in of_set]
    vectors.minimise(kind, some, tolerance, judge)
    yield from zip((i for i, _ in of_set), some, strict=True)


class SharedVectors(Newton):
    """Documents as counts of known terms, and what each training set makes of them.

    ``docs``: label, tokens or counted terms, and ``trains``, the numbers (0,
    1, ...) of the training sets that a document is in. Optional: ``held``, the
    sets that it is held out for, and ``slice``, the number of a part that
    accuracies are told apart by. The vocabulary of each set,
    ``options.max_features`` terms at most, and one number per set and term are
    held by the driver and sent to the workers; documents never are.

    Blocks are kept for many passes; for a single one (``kept`` false) they are
    made and summed in the same worker.

    Labels are 0 or 1. Documents without known terms have the intercept alone;
    null token lists count as empty ones.
    """

    def __init__(self, docs: DataFrame, options: feat.VectorOptions, n_sets: int = 1, n_parts: int = 1, ratio: bool = False, kept: bool = True):
        if options.max_features is None:
            raise ValueError("solvers need a bounded vocabulary")
        self.spark: SparkSession = docs.sparkSession
        ship_package(self.spark)
        self.options, self.n_sets, self.n_parts = options, n_sets, n_parts
        self.ratio: np.ndarray | None = None
        self._kept = kept
        none = F.array().cast("array<int>")
        docs = docs.withColumns({c: d for c, d in (("trains", F.array(F.lit(0))), ("held", none), ("slice", F.lit(0))) if c not in docs.columns})
        if f"terms_{options.ngram_max}" not in docs.columns:
            docs = feat.count_terms(docs, options.ngram_max)
        own = F.array_distinct("trains")
        sizes = docs.select(F.explode(own).alias("fit"), F.size(own).alias("sets")).groupBy("fit").agg(F.count("*").alias("docs"), F.max("sets").alias("sets")).collect()
        self.n_docs = np.zeros(n_sets)
        for row in sizes:
            self.n_docs[row["fit"]] = row["docs"]
        self._disjoint = all(row["sets"] == 1 for row in sizes)
        self._shuffled = 0
        self.vocabulary, df = self._vocabularies(docs)
        # One row per training set; ``idf`` and ``df`` are seen with one column per set.
        if options.use_idf:
            self._idf = np.where(df > 0, np.log((1.0 + self.n_docs[:, None]) / (1.0 + df)) + 1.0, 0.0)
        else:
            self._idf = (df > 0).astype(float)
        #: A set's counts: its documents that have a term, summed over its terms.
        self.n_counts = df.sum(axis=1)
        del df
        self.idf = self._idf.T
        self.blocks = self._read(docs)
        self.scale = self._idf
        if ratio:
            p, q, _, _ = self._class_sums()
            self.ratio = self._log_shares(p, 1.0) - self._log_shares(q, 1.0)
            self.scale = self._idf * self.ratio

    def _class_sums(self) -> list[np.ndarray]:
        sets, shape = np.arange(self.n_sets), self._idf.shape
        p, q, positive, negative = self._sum(_class_sums, {"sets": sets}, [shape, shape, (self.n_sets,), (self.n_sets,)])
        p *= self._idf
        q *= self._idf
        return [p, q, positive, negative]

    def _log_shares(self, sums: np.ndarray, alpha: float) -> np.ndarray:
        """Logarithm of each known term's share of a class; 0 for unknown ones."""
        out = np.zeros_like(sums)
        for row, own, to in zip(sums, self._idf, out, strict=True):
            known = own > 0
            smoothed = row[known] + alpha
            to[known] = np.log(smoothed) - np.log(smoothed.sum())
        return out

    def naive_bayes(self, alphas: tuple[float, ...]) -> list[Fit]:
        """The closed form of every training set and smoothing value, from one pass."""
        p, q, positive, negative = self._class_sums()
        fits = []
        for alpha in alphas:
            weights = self._log_shares(p, alpha) - self._log_shares(q, alpha)
            for i, (n, m) in enumerate(zip(positive, negative, strict=True)):
                bias = ONE_CLASS if m == 0 else -ONE_CLASS if n == 0 else float(np.log(n / m))
                fits.append(Fit(i, alpha, weights[i], bias, converged=True, n_docs=int(n + m), n_features=int((self._idf[i] > 0).sum())))
        return fits

    def _vocabularies(self, docs: DataFrame) -> tuple[pa.Array, np.ndarray]:
        """All terms that some training set keeps, and their document frequency in each set (rows; 0 where it doesn't).

        A term is counted for all sets in one row, from the documents or, for
        more than a few sets, from its counts by the sets that documents are in,
        of which folds have few. Beyond MANY_SETS, or where no document is in two
        sets, every set has rows of its own.
        """
        options = self.options
        if self._disjoint:
            rows = feat.term_rows(docs.filter(F.size("trains") > 0).withColumn("fit", F.array_distinct("trains")[0]), ["fit"], options.ngram_max)
            per_set = settle(rows.groupBy("fit", "term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf")).filter(F.col("df") >= options.min_df), "set-counts")
        elif self.n_sets <= MANY_SETS:
            inside = [F.when(F.array_contains("trains", i), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(self.n_sets)]
            sets = docs.filter(F.size("trains") > 0).withColumn("sets", sum(inside[1:], inside[0]))
            rows = feat.term_rows(sets, ["sets"], options.ngram_max).withColumns({"df": F.lit(1).cast("bigint"), "cf": F.col("tf").cast("bigint")})
            counted = ("df",) if options.binary else ("df", "cf")
            if self.n_sets > FEW_SETS:
                rows = rows.groupBy("sets", "term").agg(*[F.sum(c).cast("bigint").alias(c) for c in counted])
            own = [F.shiftright("sets", i).bitwiseAND(F.lit(1).cast("bigint")) for i in range(self.n_sets)]
            wide = rows.groupBy("term").agg(*[F.sum(x * F.col(c)).cast("bigint").alias(f"{c}_{i}") for i, x in enumerate(own) for c in counted])
            enough = [F.col(f"df_{i}") >= options.min_df for i in range(self.n_sets)]
            wide = settle(wide.filter(reduce(lambda x, y: x | y, enough)), "set-counts")
            per_set = wide.select("term", F.inline(F.array(*[
                F.struct(F.lit(i).alias("fit"), F.col(f"df_{i}").alias("df"), F.col(f"{counted[-1]}_{i}").alias("cf")) for i in range(self.n_sets)
            ]))).select("fit", "term", "df", "cf").filter(F.col("df") >= options.min_df)
        else:
            lists = docs.withColumn("trains", F.array_sort(F.array_distinct("trains"))).filter(F.size("trains") > 0)
            counts = feat.term_rows(lists, ["trains"], options.ngram_max).groupBy("trains", "term").agg(
                F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf")
            )
            per_set = settle(counts.select("term", F.explode("trains").alias("fit"), "df", "cf").groupBy("fit", "term").agg(
                F.sum("df").alias("df"), F.sum("cf").alias("cf")
            ).filter(F.col("df") >= options.min_df), "set-counts")
        kept = feat.most_frequent(per_set, ["fit"], "df" if options.binary else "cf", options.max_features)
        found = kept.groupBy("term").agg(F.collect_list("fit").alias("fit"), F.collect_list("df").alias("df")).toArrow()
        found = found.sort_by("term").combine_chunks()
        df = np.zeros((self.n_sets, len(found)))
        if len(found):
            fit, n = (pc.list_flatten(found[c]).to_numpy() for c in ("fit", "df"))
            row = np.repeat(np.arange(len(found)), pc.list_value_length(found["fit"]).to_numpy())
            df[fit, row] = n
        return pa.concat_arrays([pa.array([], pa.string()), *found["term"].cast(pa.string()).chunks]), df

    def _read(self, docs: DataFrame) -> RDD:
        context = self.spark.sparkContext
        vocabulary, squares = context.broadcast(self.vocabulary), context.broadcast(self._idf * self._idf)
        stored = docs.select(
            F.col("label").cast("tinyint").alias("label"), F.col("slice").cast("int").alias("slice"), "trains", "held",
            F.col(f"terms_{self.options.ngram_max}").alias("terms"),
        ).mapInArrow(
            partial(_blocks, vocabulary=vocabulary, options=self.options, n_sets=self.n_sets), ", ".join(f"{c} binary" for c in _STORED),
        )
        self._sent = vocabulary, squares
        # A pass yields one sum per partition, so their number goes by the cores and not by the input.
        with arrow_batches(self.spark, BATCH_BYTES):
            rows = stored.coalesce(context.defaultParallelism).rdd
        # Blocks that a lost executor held are made again from the documents.
        blocks = rows.map(partial(_read_block, squares=squares, normalise=self.options.normalise))
        return blocks.persist(StorageLevel.MEMORY_AND_DISK) if self._kept else blocks

    def close(self) -> None:
        if self._kept:
            self.blocks.unpersist()

    def _sum(self, step, state: dict, shapes: list[tuple], base=None) -> list[np.ndarray]:
        """One pass: ``step`` over all blocks. Slices of the sums are added up on the executors; the driver gets each once.

        ``base``: more of the state, sent before.
        """
        context = self.spark.sparkContext
        sent = context.broadcast(state)
        try:
            parts = self.blocks.mapPartitions(partial(_over_blocks, step=step, state=sent, more=base, shapes=shapes))
            size = 8 * sum(math.prod(x) for x in shapes) * self.blocks.getNumPartitions()
            slices = (parts if size <= SLICE_BYTES else parts.reduceByKey(np.add, context.defaultParallelism)).collect()
        finally:
            sent.destroy()
        sums = [np.zeros(math.prod(x)) for x in shapes]
        while slices:
            (i, at), x = slices.pop()
            sums[i][at : at + len(x)] += x
        self._shuffled += 0 if size <= SLICE_BYTES else size
        if self._shuffled > RELEASE_BYTES:
            release(self.spark)
            self._shuffled = 0
        return [x.reshape(shape) for x, shape in zip(sums, shapes, strict=True)]

    def _fitted(self, fits: list[Fit]) -> dict:
        return self._state("", fits, np.stack([np.append(f.weights, f.bias) for f in fits]))

    def hits(self, fits: list[Fit]) -> tuple[np.ndarray, np.ndarray]:
        """Right predictions, and documents, of each part (rows) and fit (columns) among the held-out ones."""
        out = []
        for some in self._groups(fits):
            shape = self.n_parts, len(some)
            out.append(self._sum(_hits, self._fitted([fits[i] for i in some]), [shape, shape]))
        return tuple(np.concatenate(x, axis=1) for x in zip(*out, strict=True))

    def accuracies(self, fits: list[Fit]) -> np.ndarray:
        """Share of right predictions of each fit among the documents held out for its training set."""
        right, docs = self.hits(fits)
        return right.sum(axis=0) / np.maximum(docs.sum(axis=0), 1)

    def scores(self, docs: DataFrame, fits: list[Fit], keep: list[str]) -> DataFrame:
        """``keep..., number, score``: each document under every fit (its place in ``fits``) whose set is in its ``held``.

        A document's terms are looked up and weighed once for all fits, in its
        task; nothing is shuffled.
        """
        ready = f"terms_{self.options.ngram_max}"
        if ready not in docs.columns:
            docs = feat.count_terms(docs, self.options.ngram_max)
        docs = docs.select(*keep, "held", F.col(ready).alias("terms"))
        shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", number int, score double"
        out = None
        for some in self._groups(fits):
            state = self.spark.sparkContext.broadcast(self._fitted([fits[i] for i in some]))
            vocabulary, squares = self._sent
            found = docs.mapInArrow(partial(
                _scores, vocabulary=vocabulary, squares=squares, state=state, options=self.options, n_sets=self.n_sets, keep=keep,
            ), shape).withColumn("number", F.col("number") + some[0])
            out = found if out is None else out.unionByName(found)
        with arrow_batches(self.spark, BATCH_BYTES):
            return settle(out, "scores")

    def _groups(self, fits: list[Fit]) -> list[list[int]]:
        """Places of the fits of each pass, as many in one as in another."""
        size = max(1, PASS_BYTES // (8 * (self._idf.shape[1] + 1)))
        return [x.tolist() for x in np.array_split(np.arange(len(fits)), -(-len(fits) // size))] if fits else []

    def minimise(self, kind: str, fits: list[Fit], tolerance: float = TOLERANCE, judge: bool = False) -> list[Fit]:
        """Fit all ``fits``: half the squared weights and intercept, plus cost times the summed losses, least.

        With ``judge`` each fit gets its ``accuracy`` and loses its weights, of
        which the driver then holds those of one pass only.
        """
        for f in fits:
            f.n_docs, f.n_features = int(self.n_docs[f.train]), int((self._idf[f.train] > 0).sum())
        sets = sorted({f.train for f in fits})
        cores = min(len(sets), self.spark.sparkContext.defaultParallelism)
        if sets and self.n_counts[sets].max() <= OWN_COUNTS * cores:
            self._minimise_apart(kind, fits, sets, tolerance, judge)
            return fits
        for part in self._groups(fits):
            some = [fits[i] for i in part]
            self._newton(kind, some, tolerance)
            if judge:
                self.judge(some)
        return fits

    def _minimise_apart(self, kind: str, fits: list[Fit], sets: list[int], tolerance: float, judge: bool) -> None:
        """Every training set in a task of its own; a set without documents, or known terms, is summed by all."""
        context = self.spark.sparkContext
        mine = context.broadcast([(own, [(i, f.cost) for i, f in enumerate(fits) if f.train == own]) for own in sets])
        scale = context.broadcast(self.scale)
        try:
            rows = self.blocks.flatMap(partial(_dealt, sets=sets, judge=judge)).partitionBy(len(sets), int)
            found = rows.mapPartitions(partial(_fit_own, scale=scale, fits=mine, kind=kind, tolerance=tolerance, judge=judge)).collect()
        finally:
            mine.destroy()
            scale.destroy()
        for i, f in found:
            f.train, f.n_docs, f.n_features = fits[i].train, fits[i].n_docs, fits[i].n_features
            vars(fits[i]).update(vars(f))
        left = [f for i, f in enumerate(fits) if i not in {i for i, _ in found}]
        if left:
            self._newton(kind, left, tolerance)
            if judge:
                self.judge(left)

    def _send(self, state: dict):
        return self.spark.sparkContext.broadcast(state)

    def judge(self, fits: list[Fit]) -> list[Fit]:
        """Give ``fits`` their ``accuracy`` in place of their weights."""
        for f, accuracy in zip(fits, self.accuracies(fits), strict=True):
            f.accuracy, f.weights = float(accuracy), None
        return fits

    def weight_table(self, fit: Fit) -> DataFrame:
        """``fit, term, idf, ratio, weight``: what a term of weight ``idf`` adds to the margin, ratio included."""
        known = np.flatnonzero(self._idf[fit.train] > 0)
        ratio = np.ones(self._idf.shape[1]) if self.ratio is None else self.ratio[fit.train]
        frame = pd.DataFrame({
            "term": self.vocabulary.take(pa.array(known)).to_pylist(), "idf": self._idf[fit.train, known], "ratio": ratio[known],
            "weight": (fit.weights * ratio)[known],
        })
        shape = "term string, idf double, ratio double, weight double"
        return self.spark.createDataFrame(frame, shape).select(F.lit("all").alias("fit"), "*")
