"""Top-k search, WARC archives, shards and the pipeline."""

import gzip
import hashlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from loomwise.llm import shards, topk, warc
from loomwise.session import scratch_path


def brute_topk(rows, k):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vec[i] = max(vec.get(i, v), v)
    whole = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in vec.items()}
    out = []
    for q in whole:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=False)), c) for c in whole if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_matches_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in (rng.normal(size=17) * scale).astype("f4")]) for k in range(130)]
    rows += [(k, rows[0][1]) for k in range(200, 250)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (None, [1.0]), (304, []), (305, [1.0, 2.0]), (20, rows[3][1]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    for c in (16, 8192):
        got = topk.exact_top_k(spark, df, F.col("vec_id") % 20 == 0, 20, 4, c)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(rows, 20)
    assert topk.exact_top_k(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.exact_top_k(spark, df.where("vec_id IN (20, 21)"), F.col("vec_id") % 20 == 0).count() == 1


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 50, 30))
    for s in (1, 4, 7, 16):
        assert (topk.bounds(x, s) @ topk.bounds(y, s).T >= x @ y.T - 1e-9).all()


PAGES = [(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000), (3, None, None), (4, "http://c d\r\n/", "é" * 600), (5, "u", "é" * 600), (6, "u", "s" * 999), (7, "u", "s" * 999), (2, "http://b/", "x" * 2000), (None, "n", "x" * 2000), (8, "u", "")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, first int").repartition(3)
    archives = warc.write_archives(spark, pages, scratch_path(spark, "warc"))
    rows = warc.read_archives(archives).where("type <> 'warcinfo'").collect()
    assert len(rows) == len(PAGES) and all(r["gap"] is None for r in rows)
    digest = {p: hashlib.sha1((h or "").encode()).hexdigest() for p, _, h in PAGES}
    for r in rows:
        p = r["record_id"][12:-1]
        p = None if p == "null" else int(p)
        assert r["payload_digest"] == digest[p]
        kind = "revisit" if p in (1, None, 4) else "response"
        assert r["type"] == kind, p
        if kind == "revisit":
            assert r["refers_to"] == f"<urn:x-page:{5 if p == 4 else 2}>" and r["payload_bytes"] > 1000
        else:
            assert hashlib.sha1(r["payload"]).hexdigest() == digest[p]
    empty = warc.write_archives(spark, pages.limit(0), scratch_path(spark, "warc"))
    assert warc.read_archives(empty).count() == 0


def salvage(data):
    return list(warc.salvage(pa.PythonFile(io.BytesIO(data), "r")))


def test_salvage_recovers_what_follows_damage():
    rec = [warc._page_records(k, f"http://{k}/", f"page {k} " * 200, None)[0] for k in range(6)]
    gz = [gzip.compress(r, mtime=0) for r in rec]
    whole = gz[0] + rec[1] + gz[2]
    assert [g[0] for g in salvage(whole)] == ["record"] * 3
    bad = bytearray(b"".join(gz))
    at = len(gz[0]) + len(gz[1]) // 2
    bad[at : at + 9] = b"\x00" * 9
    got = salvage(bytes(bad))
    assert [g[0] for g in got] == ["record", "gap", "record", "record", "record", "record"]
    assert got[1][1:3] == (len(gz[0]), len(gz[1]))
    assert sum(g[2] for g in got) == len(bad)
    cut = salvage(b"junk" + gz[3][:50] + rec[4] + gz[5][:-30])
    assert [g[0] for g in cut] == ["gap", "record", "gap"] and cut[2][3] == "member is cut short"
    wrong = rec[2].replace(b"page 2 page", b"page 9 page", 1)
    got = salvage(rec[1] + wrong + gzip.compress(wrong) + rec[3])
    assert [g[0] for g in got] == ["record", "gap", "gap", "record"] and got[1][3] == "block digest differs"
    assert salvage(b"") == [] and [g[0] for g in salvage(b"\x1f\x8b\x08" * 9)] == ["gap"]
    rng = random.Random(1)
    for _ in range(60):  # any damage: no crash, the file is tiled, records before the damage stand
        hurt = bytearray(b"".join(gz))
        spot = rng.randrange(len(hurt))
        hurt[spot : spot + rng.randrange(1, 40)] = rng.randbytes(rng.randrange(40))
        got = salvage(bytes(hurt))
        assert sum(n for _, n in {(g[1], g[2]) for g in got}) == len(hurt) and sum(g[0] == "record" for g in got) >= 4


def test_reader_logs_gaps(spark, tmp_path):
    rec = [gzip.compress(warc._page_records(k, "u", "y" * 50, None)[0]) for k in range(3)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(rec[0] + b"????" + rec[1] + rec[2][:-9])
    rows = warc.read_archives(spark.createDataFrame([(str(path),)], "path string")).orderBy("offset").collect()
    # the last record is whole, though its member isn't
    assert [r["gap"] for r in sorted(rows, key=lambda r: (r["offset"], r["gap"] or ""))] == [None, "neither a member nor a version line", None, None, "member is cut short"]


def test_shards_keep_every_row_and_commit_whole_versions(spark):
    docs = spark.createDataFrame([(k % 90 if k % 7 else None, None if k % 5 == 0 else "t" * k, k) for k in range(100)], "doc_id long, text string, _run int")
    store = shards.ShardStore(spark, scratch_path(spark, "store"), target_bytes=1 << 20, fanout=3)
    assert store.version() == 0
    for a in shards.arrivals(docs, 5):
        store.append(a)
    store.append(docs.limit(0))
    assert store.version() == 6 and len(store.manifest()["runs"]) == 5
    before = sorted(map(tuple, docs.collect()), key=repr)
    assert store.compact() >= 1 and len(store.manifest()["runs"]) <= 3
    assert sorted(map(tuple, store.read().drop("_shard").collect()), key=repr) == before
    assert store.read(2).count() < 100  # an old version is still there
    old = store.manifest()
    with pytest.raises(shards.Conflict):
        store.commit(old)  # its number is taken
    store.vacuum()
    assert sorted(map(tuple, store.read().drop("_shard").collect()), key=repr) == before
    fresh = shards.ShardStore(spark, scratch_path(spark, "store"))
    fresh.append(docs.limit(0))
    assert fresh.read().count() == 0 and fresh.read().columns == [*docs.columns, "_shard"]


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n, columns = docs.count(), docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d).cache()
        m = out.count()
        assert 0 < m <= n, name
        if k < 4:
            assert out.columns == columns, name
        docs, n = out, m
    assert corpus_pipeline.run(spark, d).count() == n


def test_pipeline_on_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "the cat sat on the mat " * 9, "en", "s", 1), (1, "the cat sat on the mat " * 9, "en", "s", 1), (2, None, "en", "s", 0), (3, "", None, None, 0), (None, "the dog ran over there", None, "s", 1), (4, "the dog " * 3000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [(False, 1), (False, 4), (True, 0)]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
