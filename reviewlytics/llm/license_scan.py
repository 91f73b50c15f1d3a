"""License scan: the Dice coefficient of word bigrams with license templates."""

from __future__ import annotations

import importlib.resources
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlytics.llm.rows import given_id, keyed, pieces
from reviewlytics.runtime import ship_package

#: Fixed values: (license, wording) of common public notices.
NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _full_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of the files in ``license_texts``, read from the package, which may be an archive."""
    folder = importlib.resources.files(__package__).joinpath("license_texts")
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name))


#: Notices and full texts. Callers can give others.
TEMPLATES = NOTICES + _full_texts()
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normalised_words(text: str) -> list[str]:
    """The words in lower case, no punctuation, one spelling of license."""
    return _WORD.findall(text.lower().replace("licence", "license"))


#: Templates of at most so many words are notices, which are searched in spans of any size.
NOTICE_WORDS = 120
#: Words in which notices of one family differ.
_KINDS = frozenset((
    "affero", "lesser", "library", "nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "cc0", "isc", "mit", "bsd", "apache", "mozilla",
    "eclipse", "gnu", "cc", "creative",
))


def is_telling(word: str) -> bool:
    """Whether a notice's word tells its license, version or variant."""
    return word in _KINDS or word[0].isdigit()


def units(lines: list[str]) -> Iterator[tuple[int, int]]:
    """First line and number of lines of each line, each paragraph of several lines, and the whole text."""
    first, blocks = None, 0
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            if i < len(lines):
                yield i, 1
            first = i if first is None else first
        elif first is not None:
            blocks += 1
            if i - first > 1:
                yield first, i - first
            first = None
    if blocks > 1:
        yield 0, len(lines)


class Match(NamedTuple):
    """A span of words that is like a template: Dice is ``two / total``."""

    name: str
    size: int
    two: int
    total: int
    start: int
    end: int
    line: int
    lines: int


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], percent: int):
        self.percent = percent
        #: Per template its license, distinct bigrams, number of bigrams, and, if it is a notice, the words that tell it from its kin.
        self.sets = []
        for name, text in templates:
            words = normalised_words(text)
            if grams := set(zip(words, words[1:], strict=False)):
                telling = frozenset(w for w in words if is_telling(w)) if len(words) <= NOTICE_WORDS else None
                self.sets.append((name, grams, len(words) - 1, telling))
        #: Words that tell some notice from others; other numbers, such as years, tell nothing.
        self.telling = frozenset().union(*(t for *_, t in self.sets if t))
        self.where: dict[tuple[str, str], list[int]] = {}
        for k, (_, grams, *_) in enumerate(self.sets):
            for g in grams:
                self.where.setdefault(g, []).append(k)

    def _shared(self, grams: set[tuple[str, str]], among=None) -> dict[int, int]:
        """Per template its bigrams among ``grams``, where they are enough for the Dice coefficient of any unit."""
        shared: dict[int, int] = {}
        for g in grams & self.where.keys():
            for k in self.where[g]:
                shared[k] = shared.get(k, 0) + 1
        return {
            k: n for k, n in sorted(shared.items())
            if (among is None or k in among) and (200 - self.percent) * n >= self.percent * len(self.sets[k][1])
        }

    def matches(self, text: str) -> list[Match]:
        """All spans that reach the Dice coefficient and win against their rivals, best first.

        Of overlapping spans of different licenses the one of higher Dice stays,
        of equal ones that of the larger template, then the earlier one. A
        notice must have the words that tell it apart, and none that tell
        another.
        """
        words = normalised_words(text)
        pairs = list(zip(words, words[1:], strict=False))
        # The text has all bigrams of its units and windows, so few templates are left for these.
        alive = self._shared(set(pairs))
        if not alive:
            return []
        lines = text.split("\n")
        first = np.concatenate(([0], np.cumsum([len(normalised_words(x)) for x in lines])))
        found: list[Match] = []

        def offer(k: int, shared: int, size: int, start: int, end: int, line: int, count: int) -> None:
            name, own, length, telling = self.sets[k]
            if 200 * shared < self.percent * (len(own) + size):
                return
            if telling is None or telling == self.telling.intersection(words[start : end + 1]):
                found.append(Match(name, length, 2 * shared, len(own) + size, start, end, line, count))

        for line, count in units(lines):
            start, end = int(first[line]), max(int(first[line]), int(first[line + count]) - 1)
            grams = set(pairs[start:end])
            for k, n in self._shared(grams, alive).items():
                offer(k, n, len(grams), start, end, line, count)
        for k in alive:
            _, own, length, telling = self.sets[k]
            spans = self._windows(pairs, own, length) if telling is None else self._spans(pairs, own)
            for shared, start, end in spans:
                line, last = (int(np.searchsorted(first, i, side="right")) - 1 for i in (start, end))
                offer(k, shared, len(set(pairs[start:end])), start, end, line, last - line + 1)
        # Units come before windows and sorting is stable, so of equals at one place a unit stays.
        found.sort(key=lambda m: (-Fraction(m.two, m.total), -m.size, m.start))
        kept: list[Match] = []
        for m in found:
            if not any(m.start < o.end and o.start < m.end for o in kept):
                kept.append(m)
        return kept

    def scan(self, text: str) -> dict[str, tuple[int, int, int, int]]:
        """Per license (2 * shared, sum of sizes, first line, lines) of its best match."""
        best: dict[str, tuple[int, int, int, int]] = {}
        for m in self.matches(text):
            best.setdefault(m.name, (m.two, m.total, m.line, m.lines))
        return best

    def _spans(self, pairs: list[tuple[str, str]], own: set[tuple[str, str]]) -> list[tuple[int, int, int]]:
        """(shared, start, end): from each of the template's bigrams on, the span of any size with the highest Dice.

        A best span begins and ends with a bigram of the template. With n of
        these in the template, one of more than n * (2 / Dice - 1) bigrams
        can't be like it.
        """
        at = {i for i, g in enumerate(pairs) if g in own}
        most = (200 - self.percent) * len(own) // self.percent
        found = []
        for start in sorted(at):
            shared: set[tuple[str, str]] = set()
            size: set[tuple[str, str]] = set()
            best, i = (0, 1, 0), start
            while i < len(pairs) and (len(size) < most or pairs[i] in size):
                size.add(pairs[i])
                if i in at:
                    shared.add(pairs[i])
                    if len(shared) * best[1] > best[0] * (len(own) + len(size)):
                        best = len(shared), len(own) + len(size), i + 1
                i += 1
            if 200 * best[0] >= self.percent * best[1]:
                found.append((best[0], start, best[2]))
        return found

    def _windows(self, pairs: list[tuple[str, str]], own: set[tuple[str, str]], length: int) -> list[tuple[int, int, int]]:
        """(shared, start, end) for a full text: the windows of its ``length`` that start with one of its bigrams, cut after the last such.

        Of windows that overlap those with the most shared bigrams are left, and
        those with too few for the Dice coefficient are left out.
        """
        hits = [i for i, g in enumerate(pairs) if g in own]
        found, held, j = [], {}, 0
        for i in hits:
            while j < len(hits) and hits[j] < i + length:
                held[pairs[hits[j]]] = held.get(pairs[hits[j]], 0) + 1
                j += 1
            if (200 - self.percent) * len(held) >= self.percent * len(own):
                found.append((len(held), i, hits[j - 1] + 1))
            held[pairs[i]] -= 1
            if not held[pairs[i]]:
                del held[pairs[i]]
        found.sort(key=lambda x: -x[0])
        apart: list[tuple[int, int, int]] = []
        for one in found:
            if not any(one[1] < o[2] and o[1] < one[2] for o in apart):
                apart.append(one)
        return apart


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = 80,
) -> DataFrame:
    """One row per text and license found in it: doc_id, tag, license, dice, line_no (from 0), n_lines.

    Every line, every paragraph of several lines, the whole text, every span of
    words of any size for a notice, and for a full text every window of its
    size (cut to the first and last bigram that the template has) is compared
    with each template that has enough bigrams in the text for a Dice
    coefficient of ``percent`` / 100. Spans of different licenses that overlap
    are rivals, of which the best stays; a notice must also agree in the words
    that tell versions and variants apart. The best span of each license that
    is left is given. Templates, short notices and full texts, are a list that
    the caller bounds. No shuffle. Null and empty texts, and one-word units,
    match nothing. Null ids come back null, rows that repeat an id are scanned
    like others, and extra columns are not looked at.
    """
    ship_package(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, percent)
        for batch in pieces(batches):
            rows = [
                (doc, tag, name, two / total, line, lines)
                for doc, tag, text in zip(*(batch[c].to_pylist() for c in ("doc", "tag", "text")), strict=True)
                for name, (two, total, line, lines) in scanner.scan(text).items()
            ]
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["doc", "tag", "license", "dice", "line_no", "n_lines"],
                )

    found = keyed(docs, id_col, text_col).mapInArrow(scan, "doc long, tag long, license string, dice double, line_no int, n_lines int")
    return found.select(given_id().alias("doc_id"), "tag", "license", "dice", "line_no", "n_lines")
