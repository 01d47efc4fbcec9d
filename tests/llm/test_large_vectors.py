"""Top-k over long vectors and large components, against whole numbers without bound."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwise.llm import topk


def brute(rows, k):
    whole = [(i, [int(v) for v in np.floor(64 * np.array(x))]) for i, x in rows]
    out = {}
    for i, q in whole:
        if i % 20 == 0:
            each = [(-min(max(sum(a * b for a, b in zip(q, c, strict=True)), -(2**63) + 1), 2**63 - 1), j) for j, c in whole if j != i]
            out[i] = [(j, -s) for s, j in sorted(each)[:k]]
    return out


@pytest.mark.parametrize("dims,scale", [(1536, 1.0), (2500, 2.0**13), (8, 2.0**24), (8, 2.0**40), (5, 1e200), (1025, 1e-9)])
def test_top_k_of_large_vectors(spark, dims, scale):
    rng = np.random.default_rng(dims)
    rows = [(k, (rng.normal(size=dims) * scale).tolist()) for k in range(60)]
    rows[7] = (7, rows[3][1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.exact_top_k(spark, df, F.col("vec_id") % 20 == 0, k=6, query_rows=2, candidate_rows=25).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(rows, 6)


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for bits in (10, 21, 30, 40, 52):
        x, y = (np.floor(rng.normal(size=(5, 1100)) * 2.0**bits / 40) for _ in range(2))
        want = [[min(max(sum(int(a) * int(b) for a, b in zip(p, q, strict=True)), -(2**63) + 1), 2**63 - 1) for q in y] for p in x]
        assert topk.products(x, y).tolist() == want


def test_blocks_of_long_vectors_take_no_longer_than_their_products():
    x = np.floor(np.random.default_rng(1).normal(size=(3000, 1536)) * 64)
    began = time.time()
    topk._best(x[:1000], np.arange(1000), np.full(1000, topk.NONE), x, np.arange(3000), 20)
    assert time.time() - began < 20


def test_one_long_vector_among_short_ones(spark):
    """Each class of lengths has a matrix of its own, so the short rows are not padded to the long one."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=1 + k % 9).tolist()) for k in range(2000)] + [(2000, rng.normal(size=100_000).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    topk.exact_top_k(spark, df.where("vec_id < 40"), F.col("vec_id") % 20 == 0, k=3).collect()
    began = time.time()
    got = {}
    for r in topk.exact_top_k(spark, df, F.col("vec_id") % 20 == 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert time.time() - began < 15
    pad = [(i, x + [0.0] * (9 - len(x)) if i < 2000 else x[:9]) for i, x in rows]
    want = brute(pad, 6)
    assert all(got[q] == want[q] for q in want if q < 2000) and len(got[2000]) == 6
    assert [v for v, _ in got[2000]] == [v for v, _ in want[2000]]
