"""Small texts against plain versions: nulls, blanks, repeats, ties, extra columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewlytics.llm import (
    bpe, catalogue, exact_dedup, license_scan, line_dedup, lm_scores, near_dedup, packing, quality_rules, substring_dedup, wavelet,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [f"w{i}" for i in range(60)] + ["Der", "is", "naïve", "漢字", "a.b,", "##"]


def _texts():
    pick = random.Random(3)
    make = lambda n: " ".join(pick.choice(WORDS) for _ in range(n))
    one, two = make(90), make(120)
    shared = make(50)
    near = two.split(" ")
    near[5] = "other"
    texts = [
        one, one, one.upper(), two, " ".join(near), make(30) + " " + shared + "\n" + make(20), make(7) + "  " + shared,
        None, "", " \n\t ", "x", "x", make(4000), "a b " * 60, "same line here\n" * 20 + make(60),
    ]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"h{i % 3}" if i % 4 else None, "c", 1) for i, t in enumerate(_texts())]
    rows += [(None, "no id", "h1", "c", 1), rows[3], (4, "another text of id 4", "h1", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, name int").repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(found, want):
    assert Counter(tuple(r) for r in found.collect()) == Counter(want)


def test_substrings(docs, rows):
    seen = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for doc, text in rows:
        w = words(text)
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        want.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    same(substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256"), want)


def test_exact(docs, rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(-1 if doc is None else doc)
    want = [
        (doc, None if (m := max(groups[lower(t)])) < 0 else m, len(groups[lower(t)]), (-1 if doc is None else doc) == m, sha(lower(t)))
        for doc, t in rows
    ]
    found = exact_dedup.exact_groups(docs, block_chars=16)
    same(found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), want)


def test_quality(docs, rows):
    found = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars, r.n_symbols) for r in quality_rules.quality_verdicts(docs).collect()}
    want = set()
    for doc, text in rows:
        w = words(text)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want.add((doc, len(w), len(cover), len(lines) - len(set(lines)), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))))
    assert found == want


def test_near(docs, rows):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    ids = [-1 if d is None else d for d, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    low = {g: min(ids[i] for i in range(len(ids)) if group[i] == g) for g in group}
    want = [(d, len(sets[i]), None if (c := low[group[i]]) < 0 else c, ids[i] == c) for i, (d, _) in enumerate(rows)]
    same(near_dedup.near_groups(docs, shingle=2).drop("tag"), want)


def test_bpe(docs, rows):
    tokenizer = Tokenizer.from_file(PATH)
    want = [(d, tuple(tokenizer.encode(t, add_special_tokens=False).ids), t) for d, t in rows]
    found = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()
    assert Counter((None if r.doc < 0 else r.doc, tuple(r.ids), r.decoded) for r in found) == Counter(want)


def test_bpe_odd_texts():
    pick, tokenizer = random.Random(1), Tokenizer.from_file(PATH)
    parts = ["a", "th", "'s", " ", "  ", "\n", "\x1c", "\x85", "9", "½", "é", "字", "🙂", "<|endoftext|>", "...", "​", "x" * 40, "\x00"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(25))) for _ in range(2000)]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for coder in (bpe.encoder(PATH), bpe.library_encoder(PATH)):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want


def test_packing(docs, rows):
    tokenizer = Tokenizer.from_file(PATH)
    sizes = Counter((d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in rows)
    found = packing.pack(docs, PATH, capacity=256).collect()
    total, bins = Counter(), defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
        total[(r.doc_id, r.tag)] += r.length
    assert sum(total.values()) == sum(n * k for (_, n), k in sizes.items())
    for items in bins.values():
        items.sort()
        assert all(at == sum(n for _, n in items[:i]) for i, (at, _) in enumerate(items))
        assert sum(n for _, n in items) <= 256


def test_packing_query(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for piece, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : first if not piece else a + 2048]
            want[doc, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = catalogue.op4_best_fit_packing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert all(at == sum(n for _, n in items[:i]) for i, (at, _) in enumerate(items)) and sum(n for _, n in items) <= 2048
    sizes = sorted((r.length for r in found), reverse=True)
    assert len(bins) <= max(sum(n > 1024 for n in sizes), -(-sum(sizes) // 2048)) + 1


def test_bpe_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    ids = [(d, tokenizer.encode(t, add_special_tokens=False).ids) for d, t in rows]
    want = Counter((d, len(x), sha(",".join(map(str, x))), sha(tokenizer.decode(x, skip_special_tokens=False))) for d, x in ids)
    assert Counter(map(tuple, catalogue.op2_bpe(spark, str(tmp_path)).collect())) == want


def test_suffix_automaton():
    tokens = {b"a": 0, b"b": 1, b"ab": 2, b"bab": 3, b"cabb": 4, b"bb": 5}
    auto = bpe.SuffixAutomaton(tokens)
    pick = random.Random(3)
    for _ in range(200):
        text = bytes(pick.choice(b"abcd") for _ in range(pick.randrange(1, 12)))
        state, have = np.zeros(1, np.int32), np.zeros(1, np.int32)
        for i, c in enumerate(text):
            state, have = auto.advance(state, have, np.array([c], np.uint8))
            ends = [text[j : i + 1] for j in range(i + 1)]
            assert have[0] == max((len(e) for e in ends if any(e in t for t in tokens)), default=0)
            s, got = int(state[0]), []
            if auto.token[s] < 0 or have[0] != auto.length[s]:
                s = int(auto.next[s])
            while s >= 0:
                got.append(int(auto.token[s]))
                s = int(auto.next[s])
            assert got == [tokens[e] for e in ends if e in tokens]


def test_plan_is_close_to_the_bound():
    pick = random.Random(5)
    for _ in range(50):
        counts = Counter(pick.randrange(1, 101) for _ in range(pick.randrange(400)))
        fill, placed = defaultdict(list), Counter()
        for n, lo, hi, first, each, at in packing.plan(dict(counts), 100):
            for rank in range(hi - lo):
                fill[first + rank // each].append((at + rank % each * n, n))
            placed[n] += hi - lo
        assert placed == counts
        for items in fill.values():
            items.sort()
            assert all(a == sum(n for _, n in items[:i]) for i, (a, _) in enumerate(items))
            assert sum(n for _, n in items) <= 100
        large = sum(c for n, c in counts.items() if n > 50)
        assert len(fill) <= max(large, -(-sum(n * c for n, c in counts.items()) // 100)) * 1.25 + 2


def test_wavelet_matrix():
    ids = np.random.default_rng(2).integers(0, 50, 3000)
    matrix = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids, 6))
    assert (matrix.ids() == ids).all()
    assert [matrix[i] for i in (0, 511, 512, 2999)] == [int(ids[i]) for i in (0, 511, 512, 2999)]
    for token in (0, 7, 49, 63):
        where = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(where)
        assert matrix.count(token, 1500) == (where < 1500).sum()
        assert [matrix.find(token, k) for k in range(len(where))] == where.tolist()
    assert wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids[:0], 6)).ids().size == 0


def test_token_files(spark, docs, rows):
    tokenizer, path = Tokenizer.from_file(PATH), wavelet.token_folder(spark)
    wavelet.write_tokens(docs, PATH, path, shard_tokens=500)
    found = sorted(wavelet.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((d, crc(t)) for d, t in rows)


def test_licenses(spark):
    texts = ["Released under the MIT License.", "x\nreleased, under the mit licence\ny", "Released under no license", None, ""]
    found = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r.doc_id, r.license, r.dice, r.line_no) for r in found.collect()} == {(0, "MIT", 1.0, 0), (1, "MIT", 1.0, 1)}


def test_lines(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(60))
    texts = [long + "\nalone", "LONG: 1\n" + long.upper() + " 22", "long\n\n", None, ""]
    found = line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no, r.group_size, r.keep_doc_id, r.keep_line_no, r.kept) for r in found} == {
        (0, 0, 2, 0, 0, True), (1, 1, 2, 0, 0, False), (0, 1, 1, 0, 1, True), (1, 0, 2, 1, 0, True), (2, 0, 2, 1, 0, False),
    }


def test_lm_scores(docs, rows, spark):
    target = {0, 3, 12}
    found = lm_scores.cross_entropy_difference(docs, spark.createDataFrame([(x,) for x in target], "doc_id long"))
    lists = [(d, words(lower(t))) for d, t in rows]
    vocabulary = {w for _, ws in lists for w in ws}
    losses = []
    for part in (target, None):
        seen = [ws for d, ws in lists if part is None or d in part]
        one = Counter(w for ws in seen for w in ws)
        two = Counter(p for ws in seen for p in zip([None, *ws], ws, strict=False))
        before = Counter(p for ws in seen for p in [None, *ws][: len(ws)])
        size, slots = sum(one.values()), len(vocabulary) + 2
        chance = lambda p, w: (two[p, w] + 100 * (one[w] + 1) / (size + slots)) / (before[p] + 100)  # noqa: B023, E731
        losses.append([float(np.mean([-np.log2(chance(p, w)) for p, w in zip([None, *ws], ws, strict=False)])) if ws else 0.0 for _, ws in lists])
    want = sorted((-1 if d is None else d, len(ws), round(a, 6), round(b, 6)) for (d, ws), a, b in zip(lists, *losses, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6)) for r in found.collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert substring_dedup.substring_dedup(none).isEmpty()
    assert exact_dedup.exact_groups(none).isEmpty()
    assert quality_rules.quality_verdicts(none).isEmpty()
    assert near_dedup.near_groups(none).isEmpty()
    assert packing.pack(none, PATH).isEmpty()
    assert bpe.bpe_decode(bpe.bpe_encode(none, PATH), PATH).isEmpty()
    assert line_dedup.line_groups(none).isEmpty()
    assert license_scan.license_scan(none).isEmpty()
    assert lm_scores.cross_entropy_difference(none, none).isEmpty()
    path = wavelet.token_folder(spark)
    wavelet.write_tokens(none, PATH, path)
    assert wavelet.read_tokens(spark, path).isEmpty()
