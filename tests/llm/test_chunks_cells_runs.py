"""Operators 11 to 13 against plain versions: nulls, blanks, repeats, ties, extra columns, empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from reviewlytics.llm import catalogue, chunked_bpe, divergence, periodic_runs

CODER = (catalogue.RANKS, public_tokenizers.PATTERN)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def library():
    with open(catalogue.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    pick = random.Random(7)
    part = ["a", "th", "'s", "'", "!", " ", "  ", "\n", "\r\n", "\x1c", "\x85", "9", "½", "é", "字", "🙂", "<|endoftext|>", "...", "​", "\x00", "Straße"]
    odd = ["".join(pick.choice(part) for _ in range(pick.randrange(400))) for _ in range(60)]
    prose = [" ".join(pick.choice(("der", "Der", "film", "is", "not", "gut,", "café", "x1", "漢字")) for _ in range(pick.randrange(200))) for _ in range(30)]
    runs = ["b" * 700 + " c" * 90, " " * 500 + "x" + "\n" * 300 + "y", "!" * 257 + "'story" * 40, "a b " * 70, "w " * 41]
    return [*odd, *prose, *runs, None, "", " \n ", prose[0], prose[0]]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], f"h{i % 4}" if i % 5 else None, "c", 1, i) for i, t in enumerate(_texts())]
    return [*out, (None, "no id, no id " * 9, "en", "h1", "c", 1, 0), out[70], (4, "another text of id 4", "fr", "h9", "c", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    shape = "doc_id long, text string, lang string, source string, ids string, row int, runs int"
    return spark.createDataFrame(rows, shape).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (50, 50), (1 << 16, 1 << 10)])
def test_chunked_bpe(docs, rows, library, chunk, overlap):
    tokens = chunked_bpe.decode(chunked_bpe.chunked_encode(docs, *CODER, chunk=chunk, overlap=overlap), *CODER).collect()
    want = Counter((r[0], tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((None if r.doc < 0 else r.doc, tuple(r.ids), bytes(r.decoded)) for r in tokens) == want


def test_chunked_bpe_query(spark, docs, rows, library, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.op11_chunked_bpe(spark, str(tmp_path)).collect()
    ids = [(r[0], library.encode_ordinary(r[1] or ""), r[1] or "") for r in rows]
    assert Counter(map(tuple, found)) == Counter((d, len(x), sha(" ".join(map(str, x))), sha(t)) for d, x, t in ids)


def test_chunked_bpe_of_broken_characters(spark, library):
    tokens = spark.createDataFrame([(1, library.encode_ordinary("字")[:1]), (2, None)], "doc long, ids array<int>")
    assert {r.doc: bytes(r.decoded) for r in chunked_bpe.decode(tokens, *CODER).collect()} == {1: library.decode_bytes(library.encode_ordinary("字")[:1]), 2: b""}


def _audit(rows):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    own = [(r[2] or "", r[3] or "", terms(r[1])) for r in rows]
    out = []
    for lang in {x[0] for x in own}:
        held = Counter(t for a, _, w in own if a == lang for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= 3)
        counts = defaultdict(Counter)
        for a, source, w in own:
            if a == lang:
                counts[source].update(t for t in w if held[t] >= 3)
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        mean = {t: 1 + 10**9 * (whole[t] + 1) // (whole.total() + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in share.items():
            pairs = sorted((-sum(f(p[t], q[t]) for t in kept), o.encode()) for o, q in share.items() if o != s)
            apart = sorted((-f(p[t], mean[t]), t.encode()) for t in kept if counts[s][t] and p[t] > mean[t])[:200]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", apart)) for k, (v, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize(("group_block", "term_block"), [(64, 4096), (2, 5), (1, 1)])
def test_divergence(docs, rows, group_block, term_block):
    found = divergence.divergence_audit(docs, group_block=group_block, term_block=term_block)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == Counter(_audit(rows))


def test_divergence_without_kept_terms(spark):
    docs = spark.createDataFrame([("one two", "en", "a"), ("one", "en", "b"), ("", "en", "c")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergence_audit(docs).collect()))[:2] == [("en", "a", "pair", "b", 0, 1), ("en", "a", "pair", "c", 0, 2)]


def test_divergence_slices():
    text = b"ab " * (divergence.SLICE_BYTES // 3 + 100) + b"x" * (divergence.SLICE_BYTES + 5)
    parts = list(divergence._slices(text))
    assert b"".join(parts) == text and len(parts) > 1
    assert [x for p in parts for x in divergence._TERM.findall(p)] == divergence._TERM.findall(text)


def _runs(w, exponent, shortest):
    out, n = [], len(w)
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            least = not any(all(w[i + x] == w[i + x + q] for x in range(size - q)) for q in range(1, p))
            if j > i and size >= max(shortest, exponent * p) and least:
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_of_random_words():
    pick = random.Random(1)
    for _ in range(600):
        w = [pick.randrange(pick.choice((1, 2, 3))) for _ in range(pick.randrange(1, 40))]
        w += [w[x % pick.randrange(1, 6) % len(w)] for x in range(pick.randrange(20))] + w[:5]
        for exponent, shortest in ((2, 2), (3, 4), (4, 6)):
            assert periodic_runs.runs_of(w, exponent, shortest) == _runs(w, exponent, shortest)
            parts = periodic_runs.dense_parts(np.array(w, np.uint64), np.array([0, len(w)]), exponent, shortest)
            assert sorted((a + s, n, p) for a, b in parts for s, n, p in periodic_runs.runs_of(w[a:b], exponent, shortest)) == _runs(w, exponent, shortest)


def test_periodic_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text, *_ in rows:
        w = words(text)
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(w)
        if doc is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = _runs(w, 4, 6)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, k, p in runs for i in range(s + p, s + k)}
        want.append((
            doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        ))
    found = catalogue.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(want)
    assert any(x[1] for x in want)


def test_strongest_compares_exactly(spark):
    runs = [(0, 9, 2), (5, 27, 6), (40, 10**9 * 4 + 1, 10**9), (41, 4, 1)]
    found = spark.createDataFrame([(runs,), (runs[2:],), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    assert [r[0] and tuple(r[0]) for r in found.select(periodic_runs.strongest()).collect()] == [runs[0], runs[2], None]


def test_long_text(spark, library):
    text = "one, two " * 30_000 + "z" * 150_000 + " end. " * 1000
    docs = spark.createDataFrame([(1, text, "en", "h")] * 2, "doc_id long, text string, lang string, source string")
    for row in chunked_bpe.chunked_encode(docs, *CODER).collect():
        assert row.ids == library.encode_ordinary(text)
    found = periodic_runs.periodic_runs(docs).select(F.size("runs"), "n_words").collect()
    assert [tuple(r) for r in found] == [(2, 61_001)] * 2
    assert divergence.divergence_audit(docs).isEmpty()


def test_empty_tables(none):
    assert chunked_bpe.decode(chunked_bpe.chunked_encode(none, *CODER), *CODER).isEmpty()
    assert divergence.divergence_audit(none).isEmpty()
    assert periodic_runs.periodic_runs(none).isEmpty()
