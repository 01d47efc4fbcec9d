"""Tables whose further columns have the names that the operators add, and odd language codes."""

import pytest

from loomwise.llm import bpe, langid
from loomwise.llm import decontaminate as dec
from loomwise.llm import line_dedup as ld

DOCS = [
    (1, "the red house stands on the hill\nthe river runs slowly through the valley", "en", 7.0, 1, "a"),
    (2, "das rote haus steht auf dem berg\nthe river runs slowly through the valley", "EN", 8.0, 2, "b"),
    (3, "la maison rouge est sur la colline\nthe river runs slowly through the valley", "w", 9.0, 3, "c"),
    (4, None, "a`b", None, None, None),
    (5, "", None, 1.0, 0, "e"),
]


def _docs(spark, *names):
    return spark.createDataFrame(DOCS, f"doc_id long, text string, lang string, {names[0]} double, {names[1]} long, {names[2]} string")


def test_language_id_replaces_its_names(spark):
    docs = _docs(spark, "score", "LANG_PRED", "other")
    model = langid.train(spark, docs)
    assert model.languages == ["EN", "en", "w"]
    got = {r["doc_id"]: r for r in model.predict(docs).collect()}
    assert set(got[1].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score", "other"}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[1]["lang_pred"] in model.languages
    kept = model.predict(docs, ("p", "s")).collect()
    assert {r["doc_id"]: (r["score"], r["LANG_PRED"]) for r in kept} == {d[0]: d[3:5] for d in DOCS}


def test_line_dedup_replaces_its_names(spark):
    got = {r["doc_id"]: r for r in ld.dedup_lines(spark, _docs(spark, "n_dropped", "N_LINES", "kept_text")).collect()}
    assert [got[k]["n_dropped"] for k in range(1, 6)] == [1, 1, 0, 0, 0] and got[1]["n_lines"] == 2
    assert got[1]["kept_text"] == "the red house stands on the hill"


def test_spans_and_ids(spark):
    docs = _docs(spark, "hit_words", "IDS", "decoded")
    items = spark.createDataFrame([("x", "the red house stands on the hill")], "item_id string, text string")
    got = {r["doc_id"]: r for r in dec.decontaminate(docs, items, remove="spans").collect()}
    assert got[1]["text"].endswith("the river runs slowly through the valley") and "house" not in got[1]["text"] and got[1]["hit_words"] == 7.0
    coded = bpe.encode_documents(docs)
    assert coded.columns == ["doc_id", "text", "lang", "hit_words", "ids", "decoded"]
    assert {r["doc_id"]: len(r["ids"]) for r in coded.collect()}[4] == 0


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([("x", "no such words in any of these documents at all")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = _docs(spark, "score", "n_dropped", "row_id").withColumnRenamed("row_id", "kept_text")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "score", "n_dropped", "kept_text"] or docs.columns == ["doc_id", "text", "lang", "score", "n_dropped", "kept_text", "n_chars"]
    assert {r["doc_id"]: r["score"] for r in docs.collect()}.items() <= {d[0]: d[3] for d in DOCS}.items()
