"""Byte-level BPE by dynamic programming over prefixes, and decoding.

The BPE encoding of a prefix has one last token, and of all tokens that end
there it is the one that is compatible with the last token of the prefix before
it. So one pass over a word stores one token per prefix; following these back
from the end gives exactly the ids that merging would give.

A suffix automaton of the vocabulary finds the tokens that end at each byte: it
holds the longest end of the prefix that stands in any token, and its suffix
links lead on to the tokens that are ends of that, longest first. Words of a
batch take their prefixes together, prefix by prefix. Two tokens are compatible
if undoing their merges, latest first, never shows a pair across their border
that would have merged earlier than a merge just undone.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from reviewlytics.llm.rows import keyed, pieces
from reviewlytics.runtime import ship_package

#: Fixed values of byte-level BPE files: the words that merging stays within, and the bytes that stand for themselves.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))

#: Words whose ids a worker keeps: some 20 MB a generation, of which there are two.
KEPT_WORDS = 100_000
BATCH_BYTES = 2 << 20
DECODED_ROWS = 1024
_STOPS = (".", ",", ";", ":", "!", "?")
_SLOTS = 1 << 20


def _byte_of_char() -> dict[str, int]:
    other = (b for b in range(256) if b not in PLAIN_BYTES)
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """The tokens of one file: bytes and ids, special ones, and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix blank is supported")
        byte = _byte_of_char()
        to_bytes = lambda token: bytes(byte[c] for c in token)
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = [tuple(to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.stops = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def parts(self, text: str) -> list[str]:
        """The text between special tokens, and these."""
        return self.stops.split(text) if self.stops and any(s in text for s in self.special) else [text]


class SuffixAutomaton:
    """All substrings of a set of tokens, as arrays: it is built once on the driver and sent to the workers.

    A state is a class of substrings that end in the same places of tokens. A
    token is the longest string of its state: nothing longer ends where it does.
    ``key`` holds (state, byte) of every step, ascending, and ``to`` where it
    leads; ``link`` the state of the longest end that is in another class,
    ``length`` each state's longest string, ``token`` its id or -1, and ``next``
    the nearest state along the links that is a token's, or -1.
    """

    def __init__(self, tokens: dict[bytes, int]):
        step: list[dict[int, int]] = [{}]
        link, length, token = [-1], [0], [-1]

        def state(size: int, steps: dict[int, int], up: int) -> int:
            step.append(steps)
            length.append(size)
            link.append(up)
            token.append(-1)
            return len(step) - 1

        def split(p: int, c: int, q: int) -> int:
            """The strings of ``q`` that ``p`` and its links reach become a state of their own."""
            copy = state(length[p] + 1, dict(step[q]), link[q])
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = copy
                p = link[p]
            link[q] = copy
            return copy

        for text, name in tokens.items():
            last = 0
            for c in text:
                p, q = last, step[last].get(c)
                if q is not None:
                    last = q if length[q] == length[p] + 1 else split(p, c, q)
                    continue
                new = state(length[last] + 1, {}, 0)
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                last = new
            token[last] = name
        key = np.fromiter(((s << 8 | c) for s, steps in enumerate(step) for c in steps), np.int64)
        to = np.fromiter((t for steps in step for t in steps.values()), np.int32)
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        self.link, self.length, self.token = (np.array(x, np.int32) for x in (link, length, token))
        self.next = np.full(len(link), -1, np.int32)
        for s in np.argsort(self.length, kind="stable")[1:].tolist():
            up = link[s]
            self.next[s] = up if token[up] >= 0 else self.next[up]

    def advance(self, state: np.ndarray, have: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state, and the length of the end it stands for, after one more byte."""
        state, have = state.copy(), have.copy()
        left = np.arange(len(state))
        while len(left):
            key = state[left].astype(np.int64) << 8 | byte[left]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            state[left[found]], have[left[found]] = self.to[at[found]], have[left[found]] + 1
            left = left[~found]
            # A byte that no token has leaves nothing of the prefix.
            root = state[left] == 0
            have[left[root]] = 0
            left = left[~root]
            state[left] = self.link[state[left]]
            have[left] = self.length[state[left]]
        return state, have


class Encoder(Vocabulary):
    """The tokenizer of one file."""

    def __init__(self, path: str, automaton: SuffixAutomaton | None = None):
        super().__init__(path)
        ids, size = self.ids, self.size
        tokens = [b""] * size
        for token, i in [*ids.items(), *((k.encode(), v) for k, v in self.special.items())]:
            tokens[i] = token
        self.bytes = pa.array(tokens, pa.binary())
        self.length = np.array([len(t) for t in tokens])
        self.left, self.right = np.arange(size), np.arange(size)
        keys, made = [], []
        for a, b in self.merges:
            joint = ids[a + b]
            self.left[joint], self.right[joint] = ids[a], ids[b]
            keys.append(ids[a] * size + ids[b])
            made.append(joint)
        order = np.argsort(keys)
        self.pairs, self.made = np.array(keys)[order], np.array(made)[order]
        self.automaton = automaton or SuffixAutomaton(ids)
        self.words = regex.compile(WORD_PATTERN)
        self.known_pairs, self.known = np.full(_SLOTS, -1), np.zeros(_SLOTS, bool)
        self.spaced: tuple[dict, dict] = {}, {}
        self.bare: tuple[dict, dict] = {}, {}

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether BPE leaves these tokens side by side; answers are kept by pair."""
        pair = one * self.size + two
        slot = (pair * 0x9E3779B1 >> 12) % _SLOTS
        new = np.flatnonzero(self.known_pairs[slot] != pair)
        answer = self.known[slot]
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            told = self._test(fresh // self.size, fresh % self.size)
            answer[new] = told[back]
            put = slot[new]
            self.known_pairs[put], self.known[put] = pair[new], answer[new]
            # Pairs that share a slot: the last one stands in both arrays, as both are written in one order.
        return answer

    def _test(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Undo the later merge of each pair until a border pair forbids it or nothing is left to undo."""
        fine = np.ones(len(one), bool)
        rows, limit = np.arange(len(one)), np.full(len(one), 1 << 60)
        while len(rows):
            at = np.minimum(np.searchsorted(self.pairs, key := one * self.size + two), len(self.pairs) - 1)
            bad = (self.pairs[at] == key) & (self.made[at] < limit)
            fine[rows[bad]] = False
            in_one, in_two = self.right[one] != one, self.left[two] != two
            first = in_one & ((one > two) | ~in_two)
            second = in_two & ~first
            limit = np.where(first, one, np.where(second, two + 1, 0))
            one, two = np.where(first, self.right[one], one), np.where(second, self.left[two], two)
            go = ~bad & (first | second)
            rows, limit, one, two = rows[go], limit[go], one[go], two[go]
        return fine

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of words, which pre-tokenization has found."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw])
        # Longest first, so that the words that reach a depth are the first ones.
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        text = np.frombuffer(b"".join(raw[i] for i in order.tolist()), np.uint8)
        start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        # The last token of each prefix, by the place of its last byte.
        last = np.full(len(text), -1)
        deep = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right").tolist()
        auto, state, have = self.automaton, np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        for depth, n in enumerate(deep):
            place = start[:n] + depth
            state, have = auto.advance(state[:n], have[:n], text[place])
            whole = (auto.token[state] >= 0) & (have == auto.length[state])
            ends = np.where(whole, state, auto.next[state])
            left = np.flatnonzero(ends >= 0)
            while len(left):
                token = auto.token[ends[left]]
                before = depth - self.length[token]
                fits = before < 0
                inner = np.flatnonzero(~fits)
                if len(inner):
                    one = last[start[left[inner]] + before[inner]]
                    # A prefix without a last token has bytes that no token has.
                    fits[inner] = (one >= 0) & self.compatible(np.maximum(one, 0), token[inner])
                last[place[left[fits]]] = token[fits]
                left = left[~fits]
                ends[left] = auto.next[ends[left]]
                left = left[ends[left] >= 0]
        at, owner = start + lengths - 1, np.arange(len(words))
        taken, whose = [], []
        while len(at):
            t = last[at]
            taken.append(t)
            whose.append(owner)
            at = at - self.length[t]
            more = at >= start[owner]
            at, owner = at[more], owner[more]
        flat, whose = np.concatenate(taken[::-1]), order[np.concatenate(whose[::-1])]
        ids = flat[np.argsort(whose, kind="stable")].astype("<u4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(words))))) * 4
        return [ids[a:b] for a, b in itertools.pairwise(cuts.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as the tokenizers library gives them without special tokens of its own."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for piece in self.parts(text):
                parts.append(piece)
                owner.append(i)
        out: list[list[bytes]] = [[] for _ in texts]
        for i, ids in zip(owner, self._plain(parts), strict=True):
            out[i].append(ids)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """A blank between two other characters always begins a word, so texts fall apart there.

        A part that has white space at an end, or is empty, stands beside more
        white space: its text goes through the pattern as a whole.
        """
        split = [t.split(" ") for t in texts]
        self.spaced = self._learn(self.spaced, " ", set(itertools.chain.from_iterable(p[1:] for p in split)))
        self.bare = self._learn(self.bare, "", {p[0] for p in split})
        bare, spaced = self.bare[0], self.spaced[0]
        out = []
        for text, (head, *tail) in zip(texts, split, strict=True):
            if text in self.special:
                out.append(self.special[text].to_bytes(4, "little"))
                continue
            ids = [bare[head], *map(spaced.__getitem__, tail)]
            if None in ids:
                words = self.words.findall(text)
                own = {w: spaced.get(w[1:]) if w[0] == " " else None for w in words}
                new = [w for w, known in own.items() if not known]
                own.update(zip(new, self.encode_words(new), strict=True))
                ids = map(own.__getitem__, words)
            out.append(b"".join(ids))
        return out

    def _learn(self, held: tuple[dict, dict], lead: str, parts: set[str]) -> tuple[dict, dict]:
        """Two generations of known parts, the younger with the ids of all ``parts``.

        None stands for parts beside more white space. What isn't met while a
        generation fills is forgotten.
        """
        known, older = held if len(held[0]) <= KEPT_WORDS else ({}, held[0])
        new, split = parts.difference(known), {}
        again = new.intersection(older)
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        new -= again
        for part in new:
            if part.isalpha():
                split[part] = (lead + part,)
            elif (lead and not part) or (part and (part[0].isspace() or part[-1].isspace())):
                known[part] = None
            elif part[-1:] in _STOPS and part[:-1].isalpha():
                split[part] = (lead + part[:-1], part[-1])
            else:
                split[part] = self.words.findall(lead + part)
        table: dict[str, bytes] = {}
        words = set(itertools.chain.from_iterable(split.values()))
        if lead:
            for word in words:
                if word[0] == lead and (ids := known.get(word[1:])):
                    table[word] = ids
        words = list(words.difference(table))
        table.update(zip(words, self.encode_words(words), strict=True))
        for part, its in split.items():
            known[part] = table[its[0]] if len(its) == 1 else b"".join(map(table.__getitem__, its))
        return known, older

    def decode(self, lists: pa.Array) -> pa.Array:
        """The texts of lists of ids; bytes that aren't UTF-8 become U+FFFD. Null lists are empty texts."""
        ends = np.cumsum(np.concatenate(([0], np.asarray(pc.fill_null(pc.list_value_length(lists), 0))))).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.bytes.take(lists.flatten())), b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


@functools.lru_cache(maxsize=4)
def automaton(path: str) -> SuffixAutomaton:
    return SuffixAutomaton(Vocabulary(path).ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, sent=None) -> Encoder:
    """The encoder of a file, built once per Python worker; ``sent`` is its automaton, broadcast."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, sent.value if sent else automaton(path))
    return _encoders[path]


class LibraryEncoder(Vocabulary):
    """The same ids from tiktoken, which finds words and merges in native code."""

    def __init__(self, path: str):
        super().__init__(path)
        self.native = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=self.ids, special_tokens={})

    def _part(self, part: str) -> np.ndarray:
        if part in self.special:
            return np.array([self.special[part]], "<u4")
        return self.native.encode_to_numpy(part, disallowed_special=())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in ([self._part(p) for p in self.parts(t)] for t in texts)]


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encoded(batch: pa.RecordBatch, coder: Encoder | LibraryEncoder, column: str = "text") -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in coder.encode(batch[column].to_pylist())]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``tag``, ``ids`` (array of int): every whole text encoded; null and empty texts have no ids.

    ``path`` is a tokenizer file that all executors can read. No shuffle. Null
    ids and rows that repeat an id are rows like others; extra columns are not
    looked at.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(automaton(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=BATCH_BYTES):
            ids = encoded(batch, encoder(path, sent))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], batch["tag"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc", "tag", "ids"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(encode, "doc long, tag long, ids array<int>")


def bpe_decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded``: the text of its column ``ids``; bytes that aren't UTF-8 become U+FFFD.

    Null and empty lists give empty texts. All other columns stay, whatever
    their names; repeated rows are rows like others. No shuffle.
    """
    ship_package(tokens.sparkSession)
    sent = tokens.sparkSession.sparkContext.broadcast(automaton(path))
    shape = f"{', '.join(f'`{c}` {t}' for c, t in tokens.dtypes)}, decoded string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, encoder(path, sent).decode(part["ids"])], [*part.schema.names, "decoded"])

    return tokens.mapInArrow(decode, shape)
