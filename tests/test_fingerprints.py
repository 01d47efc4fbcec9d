"""Fingerprints of files by what they hold, and of documents written as files."""

import os

from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameReader

from loomwise.queries import streams
from loomwise.sources import export


def test_documents_without_text_and_repeated_ids_are_whole(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "a"), (4, "b"), (5, "a"), (5, "bb"), (6, "bb"), (7, "bb"), (7, "bb"), (-8, "b"), (None, "a"), (None, "alone"), (9, "é" * 900), (10, "é" * 900)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = streams.content_fingerprint(spark, str(tmp_path)).collect()
    same = {}
    for i, t in rows:
        same.setdefault(t or "", []).append(i)
    want = [(i, min((x for x in same[t or ""] if x is not None), default=None)) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_files_without_a_byte_are_alike(spark, tmp_path):
    os.makedirs(tmp_path / "in/x")
    for name, data in (("a", b""), ("x/b", b""), ("c", b"1"), ("d", b"22"), ("x/e", b"22"), ("_f", b"23")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["fingerprint"] for r in export.fingerprints(export.listed(spark, [str(tmp_path / "in")]), chunk=1).collect()}
    assert len(got) == 6 and got["a"] == got["b"] == "size-0" and got["c"] == "size-1"
    assert got["d"] == got["e"] != got["_f"]


def test_documents_files_are_not_listed_in_the_driver(spark, tmp_path, monkeypatch):
    """Spark's reader sends every file's status to the driver, and sizes that occur twice went there, too."""
    spark.createDataFrame([(k, "x" * (k // 2)) for k in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds, rows = [], []
    kind, collect = DataFrameReader.format, DataFrame.collect
    monkeypatch.setattr(DataFrameReader, "format", lambda self, source: kinds.append(source) or kind(self, source))
    monkeypatch.setattr(DataFrame, "collect", lambda self: rows.append(collect(self)) or rows[-1])
    found = streams.content_fingerprint(spark, str(tmp_path))
    assert "binaryFile" not in kinds and all(len(r) <= 1 for r in rows)
    assert {tuple(r) for r in collect(found)} == {(k, k // 2 * 2) for k in range(40)}
