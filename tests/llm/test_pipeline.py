"""The pipeline over repeated rows and null ids, against a plain version."""

import random
import re
from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from reviewlytics.llm import sql as llm_sql
from reviewlytics.runtime import settle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    pick = random.Random(11)
    make = lambda n: " ".join(f"w{pick.randrange(5000)}" for _ in range(n))
    near = lambda t, w: " ".join([*t.split(" ")[:-1], w])
    a, b, c, d, e, f = (make(n) for n in (80, 90, 100, 110, 120, 130))
    texts = [
        (1, a), (1, a), (1, a), (None, b), (None, b), (None, b.upper()), (None, c), (None, near(c, "x")), (None, near(c, "x")),
        (5, d), (6, d), (6, d), (None, d), (7, e), (7, near(e, "y")), (8, near(e, "z")), (None, f),
    ]
    groups = [a, b, c, d, e, f]
    return [(i, t, "en", "host", len(t)) for i, t in texts], groups


def test_one_row_of_each_group_stays_whole(spark):
    rows, groups = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
    found = docs.collect()
    given = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in given for r in found)
    first = Counter(r.text.lower().split(" ")[0] for r in found)
    assert first == Counter(t.split(" ")[0] for t in groups)
    ids = {r.text.lower().split(" ")[0]: r.doc_id for r in found}
    assert [ids[t.split(" ")[0]] for t in groups] == [1, None, None, 6, 7, None]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.length for r in packed) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in found)


def test_equal_rows_of_other_columns_and_texts_without_words(spark):
    rows = [(1, "a b", "en", "h2", 3), (1, "a b", "en", "h1", 3), (None, " ", "en", "h", 1), (None, " ", "en", "h", 1), (None, "\n", "en", "h", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter([rows[1], rows[2], rows[4]])
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert Counter(tuple(r) for r in stage(spark, docs, "").collect()) == want


def _plain(rows, kept):
    """The stages after the quality rules on (doc_id, text), whose ids are all different; the near stage by full comparison."""
    texts = {d: t for d, t in rows if d in kept}
    last = {}
    for d in sorted(texts):
        last[re.sub("[A-Z]+", lambda m: m[0].lower(), texts[d])] = d
    texts = {d: texts[d] for d in last.values()}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    low = {d: [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in w] for d, w in words.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in low.items()}
    group = {d: d for d in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    words = {d: w for d, w in words.items() if group[d] == d}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[d]
    return out


def test_run_against_a_plain_version(spark, tmp_path):
    pick = random.Random(5)
    make = lambda n: " ".join(f"W{pick.randrange(900)}" for _ in range(n))
    shared, base = make(60), [make(90) for _ in range(14)]
    texts = [*base, *base[:3], base[4].lower(), *(t.rsplit(" ", 2)[0] + " odd end" for t in base[5:8])]
    texts += [make(20) + " " + shared + "\n" + make(15) for _ in range(4)] + [shared + " " + shared, make(30), "", None, " \n", "a b c " * 60]
    texts += ["# $ % # $ % " + make(60) for _ in range(6)]
    rows = [(i, t, "en", f"h{i % 3}" if i < len(texts) - 6 else "symbols", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = {d for d, k in con.sql(f"SELECT doc_id, kept FROM ({llm_sql.OP8})").fetchall() if k}
    want = _plain([r[:2] for r in rows], kept)
    assert 10 < len(want) < len(kept) < len(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, str(tmp_path)), "stage")
    assert {r.doc_id: r.text for r in docs.collect()} == want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for d, t in want.items())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
