"""Operators on more rows than their queries read, against brute force."""

import numpy as np
import pytest

from loomwise.operators import similarity
from loomwise.plans import grading
from loomwise.queries import sequences


def vectors(spark, n, dims=8, seed=5):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("n,block", [(1, 64), (2, 64), (300, 64), (300, 1024)])
def test_diversity_of_all_pairs_without_a_pair_join(spark, n, block, capsys):
    v, df = vectors(spark, n)
    cos = (v @ v.T)[np.triu_indices(n, 1)]
    got = similarity.diversity(df, block)
    r = got.first()
    assert r["mean_diversity"] == pytest.approx(max(0, 1 - cos.mean()) if n > 1 else 0)
    assert r["worst_diversity"] == pytest.approx(1 - cos.max() if n > 1 else 0.5)
    got.explain()
    assert "(a#" not in capsys.readouterr().out  # no join on a < b


def test_lsh_edges_recall(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 64))
    v[200:] = v[:200] + rng.normal(size=(200, 64)) * rng.uniform(0.2, 1.8, (200, 1))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    cos = v @ v.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cos > 0.35, 1)), strict=True)}
    got = {(r["a"], r["b"]) for r in similarity.lsh_edges(df, 0.35).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100


def test_portfolio_sees_400_rows(spark, monkeypatch):
    """120 equal vectors lead by score; the unlike ones behind them make the better set."""
    eye = np.eye(8).tolist()
    rows = [(k, eye[0] if k < 120 else eye[k % 8], 0.9 if k < 120 else 0.8, 0.5) for k in range(200)]
    df = spark.createDataFrame(rows, "idx long, v array<double>, score double, personal double")
    monkeypatch.setattr(grading, "graded", lambda spark, d: df)
    got = sequences.portfolio_topn(spark, "").collect()
    assert len(got) == 5 and sum(r["idx"] >= 120 for r in got) == 4
    assert got[0]["value"] == pytest.approx((0.9 + 4 * 0.8) / 5 + 0.5 + 1)


def clustered(n, dims=8, seed=3):
    """Vectors around a few centres, so that cells lie apart."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(12, dims))[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.15
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [0.5, 0.97])
def test_edges_around_pivots_lose_no_pair(spark, threshold):
    v = clustered(300)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    cos = v @ v.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cos > threshold, 1)), strict=True)}
    got = [(r["a"], r["b"]) for r in similarity.edges(df, threshold, block=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if threshold > 0.9:  # most rows probe no other cell
        probes = similarity._cells(df, 300, threshold, 20).where("probe AND is_left").select("id", "cell").distinct().count()
        assert probes < 300 * 14 / 4


@pytest.mark.parametrize("threshold", [0.5, 0.97])
def test_large_gatherings_have_cells_of_their_own(spark, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 4)
    monkeypatch.setattr(similarity, "INNER", 6)
    v = clustered(500, seed=9)
    v[:80] = v[0]  # equal rows
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    cos = v @ v.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cos > threshold, 1)), strict=True)}
    got = [(r["a"], r["b"]) for r in similarity.edges(df, threshold, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    cells = similarity._cells(df, 500, threshold, 16)
    assert cells.where("NOT probe").select("cell").distinct().count() > 4
    if threshold > 0.9:  # fewer pairs of blocks meet than with the gatherings alone
        inner = cells.select("cell", "probe", "p", "q").distinct().count()
        monkeypatch.setattr(similarity, "INNER", 1)
        assert inner < similarity._cells(df, 500, threshold, 16).select("cell", "probe", "p", "q").distinct().count()


def test_bank_of_any_size(spark):
    v = clustered(120)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    df, bank = spark.createDataFrame(rows[:70], "id long, v array<double>"), spark.createDataFrame(rows[70:], "id long, v array<double>")
    small = {r["id"]: r["mean_sim"] for r in similarity.topk_mean(df, bank).collect()}
    large = {r["id"]: r["mean_sim"] for r in similarity.topk_mean(df, bank, bank_rows=10).collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k]) for k in small)
    assert {r["id"] for r in similarity.add_to_bank(spark, df, bank, 0.9).collect()} == {r["id"] for r in similarity.add_to_bank(spark, df, bank, 0.9, bank_rows=10).collect()}


@pytest.mark.parametrize("timed", [True, False])
def test_bursts_are_those_of_the_sequential_pass(spark, timed, monkeypatch):
    from loomwise.operators import timeline

    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v, ts = clustered(80), rng.integers(1, 200, 80).astype(float) * timed
    score, event = rng.integers(0, 5, 80) / 4, rng.integers(0, 2, 80)
    rows = [(int(event[k]), k, v[k].tolist(), float(ts[k]), float(score[k])) for k in range(80)]
    df = spark.createDataFrame(rows, "event int, id long, v array<double>, exif_ts double, score double")
    want = set()
    for e in (0, 1):
        free = sorted((k for k in range(80) if event[k] == e), key=lambda k: (ts[k], k))
        while free:
            i = free[0]
            mine = [j for j in free if j == i or 1 - v[i] @ v[j] + abs(ts[i] - ts[j]) / 30 < 0.6]
            free = [j for j in free if j not in mine]
            want.add((e, min(mine, key=lambda j: (-score[j], j)), len(mine)))
    got = {(r["event"], r["id"], r["burst_size"]) for r in timeline.consolidate_bursts(df, ["event"]).collect()}
    assert got == want


def test_numbers_follow_the_order(spark):
    from loomwise.operators import store

    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS x").repartition(7)
    assert all(r["x"] == r["n"] for r in store.numbered(df, "x").collect())
    assert store.numbered(df.limit(0), "x").count() == 0


def test_cell_index_recall(spark):
    """Every row is stored, scores are exact, and recall against brute force is at least 0.9."""
    from loomwise.plans import items
    from loomwise.queries import similar

    d = "/root/testdata/sf0.01"
    rows = items.units(spark, d).orderBy("id").collect()
    v = np.array([r["v"] for r in rows])
    got = {}
    for r in similar.cell_search(spark, d).collect():
        assert r["cos"] == pytest.approx(v[r["query_id"]] @ v[r["id"]], abs=1e-6)
        got.setdefault(r["query_id"], []).append(r["id"])
    hits = 0
    for q in range(0, len(v), 20):
        cos = v @ v[q]
        cos[q] = -9
        hits += len(set(np.argsort(-cos)[:20].tolist()) & set(got[q]))
    assert hits >= 0.9 * 20 * len(range(0, len(v), 20))
    assert similarity.CellIndex(items.units(spark, d)).rows.count() == len(v)
