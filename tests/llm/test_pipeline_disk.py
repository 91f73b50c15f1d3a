"""What the pipeline's stages leave on disk while they run."""

import corpus_pipeline


def test_the_search_is_released_before_texts_move_again(spark, monkeypatch):
    """Fails where the shuffles of the search lie on disk beside those of the join that follows."""
    calls, kept = [], corpus_pipeline.settle
    monkeypatch.setattr(corpus_pipeline, "release", lambda spark: calls.append("release"))
    monkeypatch.setattr(corpus_pipeline, "settle", lambda df, name="t": calls.append(name) or kept(df, name))
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "y")], "doc_id long, text string")
    found = corpus_pipeline.substrings(spark, docs, "")
    assert calls[-2:] == ["cut-texts", "release"]
    assert {(r.doc_id, r.text) for r in found.collect()} == {(1, ""), (2, "x"), (3, "y")}
