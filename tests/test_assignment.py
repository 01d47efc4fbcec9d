"""The best assignment against all sets of small tables."""

from itertools import combinations, permutations

import numpy as np
import pytest

from loomwise.operators import assignment

SLOTS = ["p", "q", "r"]
KIND = "idx long, v array<double>, match double, lum01 double, cluster_id int, fit_p double, fit_q double, fit_r double"


def brute(rows, threshold=0.25, limit=0.82, k=3):
    best = None
    for c in combinations(sorted(rows), k):
        v = np.array([r[1] for r in c])
        worst = max((v @ v.T)[np.triu_indices(k, 1)])
        own = [r[4] for r in c if r[4] >= 0]
        if worst > limit or len(set(own)) < len(own) or len({r[0] for r in c}) < k:
            continue
        lum = np.array([r[3] for r in c])
        total = (np.mean([r[2] for r in c]) + 1 - worst + min(1, max(0, 1 - 3 * lum.std()))) / 3
        for p in permutations(c):
            if all(r[5 + j] >= threshold for j, r in enumerate(p)):
                key = (-round(total, 9), [r[0] for r in p])
                best = min(best, (key, total)) if best else (key, total)
    return best and (best[0][1], pytest.approx(best[1], abs=1e-9))


def table(seed, n=40, d=6, clusters=12):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), list(map(float, v[i])), float(rng.random()), float(rng.random()), int(rng.integers(-3, clusters)), *map(float, rng.random(3))) for i in rng.permutation(n)]


def found(spark, rows, **how):
    got = assignment.best_assignment(spark.createDataFrame(rows, KIND).repartition(3), SLOTS, **how).collect()
    return (got[0]["seq"], got[0]["total"]) if got else None


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_sets(spark, seed):
    rows = table(seed)
    assert found(spark, rows, sim_limit=0.5, width=4, block=7) == brute(rows, limit=0.5)


def test_the_best_set_may_hold_a_less_fit_row(spark):
    """The row that makes the best set is the least fit of all that may stand in its slot."""
    rows = [(i, [1.0, 0.0, 0.0], 0.4, 0.5, -1, 0.9 - i / 100, 0.0, 0.0) for i in range(12)]
    rows += [(20, [0.0, 1.0, 0.0], 0.4, 0.5, -1, 0.0, 0.9, 0.0), (21, [0.0, -0.5, 0.75**0.5], 0.4, 0.5, -1, 0.0, 0.0, 0.9)]
    rows.append((30, [0.0, -0.5, -(0.75**0.5)], 0.4, 0.5, -1, 0.26, 0.0, 0.0))
    got = found(spark, rows)
    assert got[0] == [30, 20, 21] and got == brute(rows)


def test_a_row_fits_some_slots_only(spark):
    rows = [(k, v, 0.5, 0.5, -1, *f) for k, v, f in ((1, [1.0, 0.0], (0.0, 0.9, 0.9)), (2, [0.0, 1.0], (0.9, 0.9, 0.0)), (3, [-1.0, 0.0], (0.9, 0.0, 0.0)), (4, [0.0, -1.0], (0.9, 0.9, 0.9)))]
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_sequence_and_repeated_rows_are_one_cluster(spark):
    rows = [(i, v, 0.5, 0.5, -1, 0.9, 0.9, 0.9) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(*r[:4], 1, *r[5:]) for r in rows]) is None


def test_nulls_and_no_rows(spark):
    rows = table(9, 20)
    odd = [(99, None, 1.0, 0.5, -1, 0.9, 0.9, 0.9), (98, [1.0] + [0.0] * 5, None, 0.5, -1, 0.9, 0.9, 0.9), (97, [1.0] + [0.0] * 5, 1.0, 0.5, -1, None, None, None)]
    assert found(spark, rows + odd) == brute(rows)
    assert found(spark, rows[:0]) is None and found(spark, rows[:2]) is None


def test_writes_no_pairs_or_growing_sets(spark, monkeypatch):
    """A table of random vectors has far more pairs within the bound than rows; none of them is written."""
    sizes = {}
    write = assignment.materialised

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(assignment, "materialised", counted)
    rows = table(5, 60, 24)
    assert found(spark, rows, sim_limit=0.25, width=4) == brute(rows, limit=0.25)
    assert max(sizes.values()) <= len(rows), sizes


@pytest.mark.parametrize("seed", [1, 6])
def test_rows_with_the_best_match_are_searched_first(spark, seed, monkeypatch):
    """Two rounds: the first gives the floor of the second, and the best set may come from either."""
    floors = []
    sets = assignment._sets
    monkeypatch.setattr(assignment, "LEAD", 4)
    monkeypatch.setattr(assignment, "_sets", lambda *a: floors.append(a[5]) or sets(*a))
    rows = table(seed)
    assert found(spark, rows, sim_limit=0.5, width=1, block=7) == brute(rows, limit=0.5)
    assert len(floors) == 2 and floors[0] <= floors[1]


def test_pairs_are_compared_in_blocks(monkeypatch):
    """Each second member was a call of its own; now a bound is taken a few times a first member."""
    rng = np.random.default_rng(3)
    n, k = 1200, 5
    v = rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cols = {"idx": np.arange(n), "match": np.sort(rng.random(n) * 0.4)[::-1], "lum01": rng.random(n), "cluster_id": rng.integers(-9, 9, n), "mask": np.full(n, 31)}
    calls = []
    reach = assignment._reach
    monkeypatch.setattr(assignment, "_reach", lambda *a: calls.append(1) or reach(*a))
    floor = 2.3
    search = assignment._Search(v, cols, k, -1 / (k - 1), 1.0, 0.25, floor)
    search.first(np.arange(n))
    assert len(calls) < 12 * n
    value, ids, worst = max(search.found)
    cos = v[ids] @ v[ids].T
    assert worst == pytest.approx(cos[np.triu_indices(k, 1)].max()) and len({c for c in cols["cluster_id"][ids] if c >= 0}) == sum(cols["cluster_id"][ids] >= 0)
    assert value == pytest.approx(cols["match"][ids].mean() + 1 - worst + max(0, 1 - 3 * cols["lum01"][ids].std()))
