"""The product-quantised index: exact with all cells, recall with some, odd rows."""

import numpy as np
import pytest

from loomwise.operators.quantised import ProductIndex, lloyd
from loomwise.plans import items

SF = "/root/testdata/sf0.1"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, asked, k):
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -np.inf
    return {q: set(np.argsort(-s, kind="stable")[:k].tolist()) for q, s in zip(asked, sims, strict=True)}


def recall(found, want):
    return sum(len(want[q] & {r["id"] for r in found if r["query_id"] == q}) for q in want) / sum(map(len, want.values()))


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def table(spark):
    return items.units(spark, SF).select("id", "v").cache()


@pytest.fixture(scope="module")
def vectors(table):
    rows = sorted(table.collect())
    return np.array([r["v"] for r in rows])


def test_recall_on_vectors_without_structure(spark, table, vectors):
    """The embeddings of the test tables, 10 of 16 cells, 28 bytes for each stored copy in place of 512."""
    index = ProductIndex(table)
    assert index.bytes_a_vector == 2 * (12 + 16) and index.blocks.selectExpr("sum(length(ids)) AS n").first()["n"] == 16 * len(vectors)
    asked = [i for i in range(len(vectors)) if i % 20 == 0]
    want = brute(vectors, asked, 20)
    got = index.search(table.where("id % 20 = 0"), probes=10).collect()
    assert all(r["cos"] == pytest.approx(vectors[r["query_id"]] @ vectors[r["id"]]) for r in got)
    assert recall(got, want) >= 0.9
    index.close()


def test_exact_with_all_cells(spark, table, vectors):
    index = ProductIndex(table, cells=8, parts=8, codes=16, block=300)
    want = brute(vectors, list(range(0, len(vectors), 50)), 7)
    got = index.search(table.where("id % 50 = 0"), k=7, probes=8, rerank=None, asked=9).collect()
    assert recall(got, want) == 1 and len(got) == 7 * len(want)
    assert all(sorted(r["rank"] for r in got if r["query_id"] == q) == list(range(1, 8)) for q in want)


def test_bounds_leave_most_rows_of_clusters_out(spark):
    rng = np.random.default_rng(4)
    x = unit(np.repeat(unit(rng.normal(size=(40, 24))), 100, 0) + rng.normal(size=(4000, 24)) * 0.02)
    df = frame(spark, x)
    index = ProductIndex(df, cells=10, parts=8, copies=1)
    asked = list(range(0, 4000, 200))
    got = index.search(df.where("id % 200 = 0"), k=10, probes=3).collect()
    assert recall(got, brute(x, asked, 10)) >= 0.99
    got = index.search(df.where("id % 200 = 0"), k=10, probes=10, rerank=None).collect()
    assert recall(got, brute(x, asked, 10)) == 1


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert ProductIndex(none).search(none).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0])], none.schema)
    assert ProductIndex(one).search(one).count() == 0
    same = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(50)], none.schema)
    got = ProductIndex(same).search(same.where("id = 7"), k=3, rerank=None).collect()
    assert [(r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 2)]
    few = ProductIndex(same).search(spark.createDataFrame([(99, [1.0, 0.0])], none.schema), k=100).collect()
    assert len(few) == 50
    with pytest.raises(ValueError):
        ProductIndex(same, codes=257)


def test_centres_of_few_rows():
    assert lloyd(np.zeros((5, 3)), 4, 1).shape == (1, 3)
    x = np.random.default_rng(0).normal(size=(500, 2))
    assert lloyd(x, 7, 1).shape == (7, 2)
