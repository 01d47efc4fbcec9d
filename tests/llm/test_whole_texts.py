"""No word, language or document is lost on the way."""

import numpy as np
import pytest

from loomwise.llm import langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_expected_counts_of_long_words(monkeypatch):
    p = langid._load(None, "piece_bpe_32k.model")
    rng = np.random.default_rng(3)
    probs = rng.random((p.n, 3)) + 0.01
    probs /= probs.sum(0)
    words = ["nationstation", "zeitungundkeit", "x"]
    counts = np.array([[2.0, 0, 1], [1, 3, 0], [0, 1, 1]])
    want = p.expected(words, counts, probs)
    monkeypatch.setattr(langid, "LONG", 0)
    assert p.expected(words, counts, probs) == pytest.approx(want)
    monkeypatch.setattr(langid, "CELLS", 1)
    assert p.expected(words, counts, probs) == pytest.approx(want)
    monkeypatch.undo()
    long = "nation" * 500
    used = p.expected([long], np.array([[1.0, 0, 2]]), probs).sum(0)
    assert np.isfinite(used).all() and used[0] > 0 and used[1] == 0 and used[2] > 0


def test_all_languages_are_learned(spark):
    rows = [(k, f"{'abcdefghijklmnopq'[k % 16]}x {'abcdefghijklmnopq'[k // 16]}", f"l{k:03}") for k in range(260)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.train(spark, labelled.where("doc_id < 20"), rounds=1, max_languages=5)
    assert len(few.languages) == 5
    assert len(langid.train(spark, labelled, rounds=1).languages) == 260


def test_pipeline_keeps_texts_of_one_id_apart(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, b + " tail", "en", "s", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1), (3, None, "en", "s", 1), (None, a, "en", "s", 1)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, [(1, a), (1, b + " tail"), (3, c), (3, None), (None, a)]))


def test_pipeline_without_languages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "the cat", None, "s", 1), (2, "12 !", None, "s", 1), (3, None, None, "s", 1)], DOCS)
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns and [r["doc_id"] for r in got.collect()] == [1]
