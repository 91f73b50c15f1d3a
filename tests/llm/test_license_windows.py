"""Licenses inside longer lines and texts, full texts, and the plain version of the best unit."""

import random

import pytest

from reviewlytics.llm import license_scan

TEXTS = dict(license_scan._full_texts())


def test_notices_within_lines_and_full_texts(spark):
    texts = [
        "Copyright 2020 Foo. Released under the MIT License. All rights reserved.",
        "intro words\nCopyright (c) 2019 A\n\n" + TEXTS["MIT"] + "\nmore words " * 50,
        "some words " * 300 + " ".join(TEXTS["Apache-2.0"].split()) + " other words" * 300,
        TEXTS["GPL-3.0"], TEXTS["BSD-2-Clause"], TEXTS["ISC"], TEXTS["MPL-2.0"], "Nothing is released under these words.",
    ]
    found = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    best = {(r.doc_id, r.license): r for r in found if r.dice == 1.0}
    assert set(best) >= {(0, "MIT"), (1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0"), (4, "BSD-2-Clause"), (5, "ISC"), (6, "MPL-2.0")}
    assert not [r for r in found if r.doc_id == 7]
    assert (best[1, "MIT"].line_no, best[2, "Apache-2.0"].n_lines) == (3, 1)


def test_spans_against_all_spans():
    pick = random.Random(2)
    templates = [("S", "a b c d e f"), ("T", "p q r s"), ("U", "f e d c b a g h i j k")]
    scanner = license_scan.Scanner(templates, 80)
    texts = ["x a b c d e f y", "a b c x a b c d e y", "a b a b c d e f a", "x b c d e", "q a b c d z e f", "a b c d e f", "p q r s\np q x r s"]
    for _ in range(300):
        words = []
        while len(words) < 30:
            words += pick.choice([t.split() for _, t in templates] + [["x"], ["y", "z"]])
            if pick.random() < 0.5:
                words.insert(pick.randrange(len(words)), "w")
        texts.append(" ".join(words))
    for text in texts:
        words = text.split()
        pairs = list(zip(words, words[1:], strict=False))
        best = {}
        for name, own in templates:
            own = set(zip(own.split(), own.split()[1:], strict=False))
            spans = [set(pairs[i:j]) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)]
            best[name] = max(2 * len(x & own) / (len(x) + len(own)) for x in spans)
        found = {name: x[0] / x[1] for name, x in scanner.scan(text).items()}
        # No template shares a bigram with another, so none is a rival.
        assert found == {name: pytest.approx(x) for name, x in best.items() if x >= 0.8}


@pytest.mark.parametrize(("name", "text"), license_scan.TEMPLATES)
def test_a_template_gives_its_own_license_only(name, text):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 80)
    assert set(scanner.scan(text)) == {name}
    assert set(scanner.scan("Copyright 2020 Foo\n\n" + text + "\nAll rights reserved.")) == {name}
    assert set(scanner.scan("some words here " + " ".join(text.split()) + " and more of them")) == {name}


def test_inserted_words_and_two_licenses():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 80)
    notices = dict(license_scan.NOTICES)
    words = notices["GPL-3.0"].split()
    words[20:20] = "nine other words that stand in the middle here".split()
    assert set(scanner.scan(" ".join(words))) == {"GPL-3.0"}
    assert set(scanner.scan("Some line that begins long before " + " ".join(words) + " and goes on for some time after it")) == {"GPL-3.0"}
    assert set(scanner.scan("Released under the MIT License. Icons: licensed under CC BY-SA 4.0. Copyright 2019.")) == {"MIT", "CC-BY-SA-4.0"}
    assert "GPL-2.0" not in scanner.scan("This work is licensed under the GNU General Public License, version 4.")
