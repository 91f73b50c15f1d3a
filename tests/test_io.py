import json

import pytest

from reviewlytics.operators import models, reports, verdict
from reviewlytics.operators.normalise import RAW, normalise
from reviewlytics.runtime import measured_bytes, scratch_folder, settle
from reviewlytics.sources import corpora, sinks
from reviewlytics.streaming.lines import review_lines, score_stream
from reviewlytics.system import SentimentSystem


@pytest.fixture
def tree(tmp_path):
    for name, files in {"neg": {"0_2": "dull", "1_4": "awful"}, "pos": {"0_9": "grand", "2_7": "fine\nplay"}}.items():
        folder = tmp_path / "train" / name
        folder.mkdir(parents=True)
        for stem, text in files.items():
            (folder / f"{stem}.txt").write_text(text, encoding="utf-8")
    (tmp_path / "train" / "urls_neg.txt").write_text("http://x/title/tt001/usercomments\nhttp://x/none\n")
    return str(tmp_path)


def test_review_tree(spark, tree):
    rows = {r.doc_id: r for r in corpora.review_tree(spark, tree, "train").collect()}
    assert set(rows) == {"train/neg/0_2", "train/neg/1_4", "train/pos/0_9", "train/pos/2_7"}
    assert rows["train/neg/0_2"].film_id == "tt001" and rows["train/neg/1_4"].film_id is None
    assert rows["train/pos/2_7"].text == "fine\nplay" and rows["train/pos/2_7"].rating == 7
    with pytest.raises(ValueError):
        corpora.review_tree(spark, tree, "dev")


def test_polarity_corpora(spark, tree, tmp_path):
    got = corpora.polarity_folders(spark, tree + "/train").orderBy("order_key").collect()
    assert sorted((r.doc_id, r.label) for r in got)[0] == ("neg/0_2.txt", 0) and len(got) == 4
    path = tmp_path / "lines.neg"
    path.write_bytes("first caf\xe9 \n\n third\n".encode("latin-1"))
    lines = {r.doc_id: r.text for r in corpora.polarity_lines(spark, {str(path): 0}).collect()}
    assert lines == {"lines.neg:0": "first café", "lines.neg:2": "third"}


def test_line_numbers_of_split_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 23) if i % 7 else "" for i in range(400)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert spark.read.text(str(tmp_path / "a.txt")).select("_metadata.file_block_start").distinct().count() > 10
        found = corpora.numbered_lines(spark, str(tmp_path / "*.txt")).collect()
        reviews = corpora.polarity_lines(spark, {str(tmp_path / "a.txt"): 1}).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file, r.line): r.value for r in found} == {(f, i): x for f in ("a.txt", "b.txt") for i, x in enumerate(lines)}
    assert {r.doc_id: r.text for r in reviews} == {f"a.txt:{i}": x.strip() for i, x in enumerate(lines) if x}


def test_named_corpora(spark, tmp_path):
    folder = tmp_path / "rt_polarity"
    folder.mkdir()
    for name in ("neg", "pos"):
        (folder / f"rt-polarity.{name}").write_bytes(f"a {name} caf\xe9\n".encode("latin-1"))
    known = corpora.film_corpora(str(tmp_path), str(tmp_path / "cache"))
    want = {("rt-polarity.neg:0", "a neg café", 0), ("rt-polarity.pos:0", "a pos café", 1)}
    for _ in range(2):
        assert {(r.doc_id, r.text, r.label) for r in known.load(spark, "rt_polarity").collect()} == want
    with pytest.raises(KeyError, match="imdb_test, imdb_train, pang_lee, rt_polarity"):
        known.load(spark, "other")


def test_cache_and_registry(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert corpora.cached(spark, path, build).count() == corpora.cached(spark, path, build).count() == 3
    assert len(calls) == 1
    known = corpora.Corpora()
    known.register("tiny", lambda s: s.range(2))
    assert known.load(spark, "tiny").count() == 2
    with pytest.raises(KeyError, match="tiny"):
        known.load(spark, "huge")


def test_review_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\ntwo\n")
    (tmp_path / "b.json").write_text(json.dumps(["x", "y"]))
    (tmp_path / "c.json").write_text(json.dumps({"reviews": ["z"]}))
    read = lambda n: sorted(r.text for r in corpora.review_list(spark, str(tmp_path / n)).collect())
    assert read("a.txt") == ["one", "two"] and read("b.json") == ["x", "y"] and read("c.json") == ["z"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "t" * 300, 0.123456)], "doc_id string, text string, score double")
    sinks.write_result_table(df.select("doc_id", "score"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().score == "0.1235"
    sinks.write_scored_reviews(df, str(tmp_path / "json"))
    row = spark.read.json(str(tmp_path / "json")).first()
    assert len(row.review) == 200 and row.sentiment == "negative"


def test_parquet_records_and_scores(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.25, True), ("b", None, False)], "doc_id string, score double, decisive boolean")
    for write, name, want in (
        (sinks.write_parquet, "table", {("a", 0.25, True), ("b", None, False)}), (sinks.write_scores, "scores", {("a", 0.25), ("b", None)}),
    ):
        for _ in range(2):
            write(df, str(tmp_path / name))
        assert {tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()} == want
    sinks.write_records(df, str(tmp_path / "records"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "records")).collect()]
    assert sorted(lines, key=str) == [{"doc_id": "a", "score": 0.25, "decisive": True}, {"doc_id": "b", "decisive": False}]
    films = spark.createDataFrame([("f", f"d{i}", 0.9 - i / 10) for i in range(6)], "film_id string, doc_id string, score double")
    sinks.write_records(verdict.compare_rules(films, n_boot=50), str(tmp_path / "verdicts"))
    rows = {r.method: r for r in spark.read.json(str(tmp_path / "verdicts")).collect()}
    assert set(rows) == set(verdict.RULES) and all(r.film_id == "f" and r.ci_low <= r.score <= r.ci_high for r in rows.values())


def test_result_tables_in_the_order_of_a_metric(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", None), ("d", 0.9)], "model string, accuracy double")
    assert [(r.model, r.place) for r in reports.sorted_by(df, "accuracy", ["model"]).collect()] == [("b", 1), ("d", 2), ("a", 3), ("c", 4)]
    assert [r.model for r in reports.sorted_by(df, "accuracy", ["model"], descending=False).collect()] == ["a", "b", "d", "c"]


def test_scratch(spark):
    small = settle(spark.range(10).selectExpr("id", "cast(id as string) as name"), "small")
    assert measured_bytes(small) == 10 * 16 + 10 and measured_bytes(spark.range(3)) == 24
    grown = spark.range(5)
    assert measured_bytes(grown) == 40
    assert scratch_folder(spark) in small.inputFiles()[0]


def test_system_round_trip_and_stream(spark, tmp_path):
    texts = [("good fun", 1), ("good story", 1), ("bad plot", 0), ("bad story", 0)] * 3
    docs = spark.createDataFrame([(i, t, y, "f") for i, (t, y) in enumerate(texts)],
                                 "doc_id int, text string, label int, film_id string")
    system = SentimentSystem(models.build_model("naive_bayes", normalise(docs, RAW)), RAW)
    system.save(str(tmp_path / "m"))
    system = SentimentSystem.load(spark, str(tmp_path / "m"))
    assert system.score(docs, ["label"]).filter("pred <> label").count() == 0
    assert system.judge_films(docs).first().n_reviews == 12
    assert system.explain(docs.limit(1)).count() > 0
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "one.txt").write_text("good fun\n\nbad plot\ngood fun\n")
    stream = score_stream(review_lines(spark, str(inbox)), system, str(tmp_path / "out"), str(tmp_path / "cp"))
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.text, r.sentiment) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("bad plot", "negative"), ("good fun", "positive"), ("good fun", "positive")]


def test_batch_scorer(spark):
    def make():
        return lambda texts: [float(len(t)) / 10 for t in texts]

    def make_array():
        import numpy as np
        inner = make()
        return lambda texts: np.array(inner(texts))

    df = spark.createDataFrame([("abcde",), ("ab",)], "text string")
    assert sorted(r.score for r in models.score_with(df, make_array).collect()) == [0.2, 0.5]
