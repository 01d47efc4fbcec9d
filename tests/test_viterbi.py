"""The best assignment of rows to slots against all predecessors of all rows."""

import numpy as np
import pytest

from loomwise.operators import selection

KIND = "idx long, pos long, v array<double>, score double, tech double, comp double, light double, narr double, human double"


def table(n, d=6, spread=1.0, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    best = rng.random(n) ** spread
    return [(int(i) * 3, k, v[k].tolist(), float(best[k]), *map(float, best[k] * rng.random(5))) for k, i in enumerate(rng.permutation(n))]


def fit(r, slot):
    names = dict(zip(["tech", "comp", "light", "narr", "human"], r[4:], strict=True))
    w, need, penalty = selection.SLOT_FIT[slot]
    x = sum(names[c] * k for c, k in w.items())
    ok = eval(need.replace("OR", "or").replace("true", "True"), {}, names)  # a condition of the fixed table
    return (x if ok else max(0.0, x - penalty)) * 0.25 + r[3] * 0.10


def brute(rows, flow, div, time, n_valid, target=5):
    v, light, pos = np.array([r[2] for r in rows]), np.array([r[6] for r in rows]), np.array([r[1] for r in rows])
    sims = v @ v.T
    step = sims * flow + (1 - sims) * div + (1 - np.abs(pos[:, None] - pos) / max(n_valid - 1, 1)) * time + np.abs(light[:, None] - light) * 0.05
    np.fill_diagonal(step, -np.inf)
    total, seqs = np.array([fit(r, 0) for r in rows]), [[r[0]] for r in rows]
    for s in range(1, target):
        each = total[None] + step
        j = each.argmax(1)  # rows are in the order of their places
        total, seqs = each[np.arange(len(rows)), j] + np.array([fit(r, s) for r in rows]), [seqs[k] + [r[0]] for r, k in zip(rows, j, strict=True)]
    at = int(total.argmax())
    return seqs[at], pytest.approx(total[at])


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.2), (0.1, 0.8, 0.0), (0.3, 0.3, 0.5)])
@pytest.mark.parametrize("n,block", [(90, 7), (90, 1024), (2, 8)])
def test_same_sequence_as_all_pairs(spark, weights, n, block):
    rows = table(n)
    got = selection.viterbi(spark.createDataFrame(rows, KIND).repartition(3), *weights, n, block=block, leaders=5).first()
    assert (got["seq"], got["total"]) == brute(rows, *weights, n)


def test_most_pairs_are_skipped_where_few_rows_lead(spark):
    rows, seen = table(600, spread=12.0, seed=4), []
    got = selection.viterbi(spark.createDataFrame(rows, KIND), 0.05, 0.02, 0.02, 600, block=30, seen=seen).first()
    assert (got["seq"], got["total"]) == brute(rows, 0.05, 0.02, 0.02, 600)
    assert len(seen) == 4 and all(all_ >= 400 for _, all_ in seen) and sum(n for n, _ in seen) < 0.5 * sum(n for _, n in seen)


def test_few_rows(spark):
    one = spark.createDataFrame(table(1), KIND)
    assert selection.viterbi(one, 0.5, 0.3, 0.2, 1).count() == 0
    assert selection.viterbi(one.limit(0), 0.5, 0.3, 0.2, 0).count() == 0


@pytest.mark.parametrize("weights,block,few", [((0.5, 0.3, 0.2), 90, True), ((0.1, 0.8, 0.0), None, False)])
def test_few_rows_of_many_are_left_by_their_bounds(spark, weights, block, few, monkeypatch):
    """All pairs are compared once and not in each slot; sequences are searched among the rows that may be in the best one."""
    left = []
    may = selection._may_lead
    monkeypatch.setattr(selection, "MANY", 100)
    monkeypatch.setattr(selection, "_may_lead", lambda *a: left.append(may(*a)) or left[-1])
    rows = table(500, seed=7)
    got = selection.viterbi(spark.createDataFrame(rows, KIND).repartition(3), *weights, 500, block=block, leaders=8).first()
    assert (got["seq"], got["total"]) == brute(rows, *weights, 500)
    assert left[0].count() < 250 or not few


def test_rows_that_tie_are_all_left(spark, monkeypatch):
    monkeypatch.setattr(selection, "MANY", 2)
    rows = [(k, k, [1.0, 0.0], 0.5, 0.5, 0.5, 0.5, 0.5, 0.5) for k in range(30)]
    got = selection.viterbi(spark.createDataFrame(rows, KIND).repartition(3), 0.5, 0.3, 0.0, 30, block=7, leaders=3).first()
    assert (got["seq"], got["total"]) == brute(rows, 0.5, 0.3, 0.0, 30)
