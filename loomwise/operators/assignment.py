"""The best assignment of rows to slots over all rows of a table, by distributed branch and bound.

A set of one row for each slot is feasible if every row is fit for its slot, no two
rows share a cluster and no two are too much alike. Its value is the mean of mean
match, worst-pair diversity and even light, which does not depend on who stands in
which slot; so sets are searched once each, in descending order of match, and slots
are dealt at the end.

A beam first finds a good feasible set. No set whose bound is below its value can
be the best: no open place matches better than the place before it, the worst pair
is no better than the pairs so far and than what their sum leaves for the open ones,
and the light spreads as far as it does already. A task has a share of the rows as
first members and all rows that the bound leaves as later ones; for one first member
at a time it compares the rows that may stand with it in blocks, goes on with what the
bound leaves of their pairs and raises its own floor by what it finds. The sets of the
LEAD rows with the best match are searched before all others, which begin with the
floor that these give. So no pairs or larger sets are written: what is shuffled is the
rows, PARTS times at most in each of the two rounds, and a task holds these rows, about
0.9 KB each, and a few blocks.

Ties go to the smaller sequence. Rows that have a null anywhere take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwise.functions.vectors import dot
from loomwise.session import forget, materialised

EPS = 1e-9
#: Rows that a task has as first members, up to PARTS tasks, and how many of them are compared at once.
BLOCK, PARTS, CHUNK = 1024, 24, 64
#: Numbers that the search holds of a product, and what single precision may be off by.
HELD, SLACK = 1 << 21, 1e-5
#: Rows whose sets are searched before all others, in tables of many more.
LEAD = 256


def _even(s, q, n: int, k: int):
    """Even light of numpy sums over n members: an upper bound for sets of k that hold them."""
    return np.clip(1 - 3 * np.sqrt(np.maximum(q - s * s / n, 0) / k), 0, 1)


def _bound(n: int, k: int, most: float, least: float) -> Column:
    """Three times the largest value of a set of k that grows from n members with the sums m, s, q and the worst pair."""
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / n, F.lit(0.0)) / k)
    even = F.least(F.greatest(1 - 3 * spread, F.lit(0.0)), F.lit(1.0))
    return (F.col("m") + (k - n) * most) / k + 1 - F.greatest(F.col("worst"), F.lit(least)) + even


@lru_cache(maxsize=None)
def _dealt(masks: tuple[int, ...]) -> bool:
    k = len(masks)
    return any(all(masks[p] >> j & 1 for j, p in enumerate(order)) for order in permutations(range(k)))


def beam_value(rows: DataFrame, k: int, most: float, least: float, sim_limit: float, width: int = 256) -> float:
    """Three times the value of a good feasible set; minus infinity if the beam finds none. It holds ``width`` states."""
    state = None
    cols = ["idx", "v", "match", "lum01", "cluster_id", "mask"]
    for n in range(1, k + 1):

        def best(batches: Iterator[pd.DataFrame], state=state, n=n) -> Iterator[pd.DataFrame]:
            for g in batches:
                if g.empty:
                    continue
                v = np.stack(g["v"].to_numpy())
                idx, match, lum, cluster, mask = (g[c].to_numpy() for c in ("idx", "match", "lum01", "cluster_id", "mask"))
                if state is None:
                    m, s, q, worst, free = match[None], lum[None], lum[None] ** 2, np.full((1, len(g)), -np.inf), np.ones((1, len(g)), bool)
                else:
                    sims = np.einsum("wnd,rd->wnr", state["v"], v)
                    worst = np.maximum(state["worst"][:, None], sims.max(1))
                    same = (state["cluster"][:, :, None] >= 0) & (state["cluster"][:, :, None] == cluster)
                    free = (state["idx"][:, -1:] < idx) & ~same.any(1) & (worst <= sim_limit)
                    m, s, q = state["m"][:, None] + match, state["s"][:, None] + lum, state["q"][:, None] + lum * lum
                value = np.where(free, (m + (k - n) * most) / k + 1 - np.maximum(worst, least) + _even(s, q, n, k), -np.inf)
                at = np.argpartition(-value, min(width, value.size - 1), axis=None)[:width]
                at = at[np.isfinite(value.ravel()[at])]
                w, r = np.unravel_index(at, value.shape)
                yield pd.DataFrame({"value": value.ravel()[at], "w": w, "worst": worst[w, r]} | {c: g[c].to_numpy()[r] for c in cols})

        found = rows.select(*cols).mapInPandas(best, "value double, w int, worst double, idx long, v array<double>, match double, lum01 double, cluster_id long, mask int")
        top = found.orderBy(F.desc("value"), "idx", "w").limit(width).toPandas()  # ``width`` rows
        if top.empty:
            return -np.inf
        grown = lambda name, new: new[:, None] if state is None else np.concatenate([state[name][top["w"]], new[:, None]], 1)
        add = lambda name, new: new if state is None else state[name][top["w"]] + new
        lum, match = top["lum01"].to_numpy(), top["match"].to_numpy()
        state = {
            "v": grown("v", np.stack(top["v"].to_numpy())),
            "idx": grown("idx", top["idx"].to_numpy()),
            "cluster": grown("cluster", top["cluster_id"].to_numpy()),
            "mask": grown("mask", top["mask"].to_numpy()),
            "worst": top["worst"].to_numpy(),
            "m": add("m", match),
            "s": add("s", lum),
            "q": add("q", lum * lum),
        }
    value = state["m"] / k + 1 - state["worst"] + _even(state["s"], state["q"], k, k)
    return max((x for x, mask in zip(value, state["mask"], strict=True) if _dealt(tuple(sorted(mask.tolist())))), default=-np.inf)


def _reach(m, last, n: int, k: int, worst, cos, s, q, least: float, size: float):
    """Three times what sets of k can reach that hold n members; the others match no better than ``last``, and ``cos`` is the sum over the pairs so far."""
    pairs, left = n * (n - 1) // 2, (k * (k - 1) - n * (n - 1)) // 2
    if left:  # the sum of k vectors has no length below 0, so the pairs that are open can't all be very unlike
        worst = np.maximum(np.maximum(worst, least) if pairs else least, -(k * size / 2 + cos) / left)
    return (m + (k - n) * last) / k + 1 - worst + _even(s, q, n, k)


def _places(of: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns, these counted from ``start``, where a table is true."""
    at = np.flatnonzero(of)
    return at // of.shape[1], at % of.shape[1] + start


def _cosines(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    few = max(1, HELD // max(v.shape[1], 1))
    return np.concatenate([np.einsum("ij,ij->i", v[i[x : x + few]], v[j[x : x + few]]) for x in range(0, len(i), few)] or [np.empty(0, v.dtype)])


class _Search:
    """Search for the best sets among rows in descending order of match, from first members on, in blocks of HELD numbers at most.

    Bounds are taken in single precision with some slack, which only keeps more; the
    sets that are left at the end are measured in double precision.
    """

    def __init__(self, v: np.ndarray, cols: dict[str, np.ndarray], k: int, least: float, size: float, sim_limit: float, floor: float):
        self.v, self.cols, self.k, self.least, self.size, self.limit, self.floor = v, cols, k, least, size, sim_limit, floor
        self.v32, self.slack = v.astype("float32"), SLACK * size
        self.found: list[tuple[float, list[int], float]] = []

    def first(self, starts: np.ndarray) -> None:
        (match, lum), k = (self.cols[c].astype("float32") for c in ("match", "lum01")), self.k
        for at in range(0, len(starts), CHUNK):
            part = starts[at : at + CHUNK]
            after = part[0] + 1
            near = self.v32[part] @ self.v32[after:].T
            for row, a in zip(near, part.tolist(), strict=True):
                if self.bound(a) < self.floor:
                    return  # no later first member can do better
                # all others match no better than the first; the light of two rows says how far that of the set spreads at least
                apart = np.abs(lum[after:] - lum[a]) * np.float32(3 / (2 * k) ** 0.5)
                may = np.maximum(row, np.float32(self.least)) + np.minimum(apart, 1) - match[after:] / k <= np.float32((k - 1) / k * match[a] + 2 - self.floor + self.slack)
                rest = np.flatnonzero(may) + after
                rest = rest[self.fit(a, rest) & (rest > a) & (row[rest - after] <= self.limit + self.slack)]
                if len(rest) >= k - 1:
                    self.seconds(a, rest, row[rest - after])

    def bound(self, a: int) -> float:
        return self.cols["match"][a] + 2 - max(self.least, -self.size / (self.k - 1))

    def fit(self, a, b) -> np.ndarray:
        """Whether rows may stand in one set."""
        c = self.cols
        return (c["idx"][a] != c["idx"][b]) & ((c["cluster_id"][a] < 0) | (c["cluster_id"][a] != c["cluster_id"][b]))

    def reach(self, n: int, m, last, worst, cos, s, q) -> np.ndarray:
        return (_reach(m, last, n, self.k, worst, cos, s, q, self.least, self.size) >= self.floor - self.slack) & (worst <= self.limit + self.slack)

    def seconds(self, a: int, rest: np.ndarray, near: np.ndarray) -> None:
        """All sets with the first member ``a`` and others of ``rest``: pairs of these are compared in blocks, and what a bound leaves goes on."""
        k, (match, lum) = self.k, (self.cols[c] for c in ("match", "lum01"))
        m = match[rest]
        one = (match[a] + m, m, near, near, lum[a] + lum[rest], lum[a] ** 2 + lum[rest] ** 2)
        second = np.flatnonzero(self.reach(2, *one))
        if k == 2:
            self.last(np.stack([np.full(len(second), a), rest[second]], 1))
            return
        # one product gives the cosine less what the third member's match adds
        v = self.v32[rest]
        right = np.concatenate([v, m[:, None].astype("float32")], 1).T
        few = max(1, HELD // len(rest))
        for at in range(0, len(second), few):
            b = second[at : at + few]
            left = np.concatenate([v[b], np.full((len(b), 1), -(k - 2) / k, "float32")], 1)
            start = b[0] + 1
            most = ((match[a] + m[b]) / k + 2 - self.floor + self.slack).astype("float32")
            i, j = _places(left @ right[:, start:] <= most[:, None], start)
            b = b[i]
            later = j > b
            self.thirds(a, rest, v, right, near, b[later], j[later])

    def thirds(self, a: int, rest: np.ndarray, v: np.ndarray, right: np.ndarray, near: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        m, lum, k = self.cols["match"][rest], self.cols["lum01"][rest], self.k
        own, light = (float(self.cols[x][a]) for x in ("match", "lum01"))
        ok = np.maximum(near[b], near[c]) - (k - 2) / k * m[c] <= (own + m[b]) / k + 2 - self.floor + self.slack
        b, c = b[ok], c[ok]
        s, q = light + lum[b] + lum[c], light**2 + lum[b] ** 2 + lum[c] ** 2
        total = own + m[b] + m[c]
        # light first, as it needs no vectors
        ok = total + (k - 3) * m[c] + k * (1 - np.maximum(self.least, np.maximum(near[b], near[c])) + _even(s, q, 3, k)) >= k * (self.floor - self.slack)
        b, c, s, q, total = (x[ok] for x in (b, c, s, q, total))
        cos = _cosines(v, b, c)
        worst, sums = np.maximum(np.maximum(near[b], near[c]), cos), near[b] + near[c] + cos
        ok = self.reach(3, total, m[c], worst, sums, s, q) & self.fit(rest[b], rest[c])
        self.sets(a, rest, v, right, near, np.stack([b, c], 1)[ok], *(x[ok] for x in (worst, sums, total, s, q)))

    def sets(self, a: int, rest: np.ndarray, v: np.ndarray, right: np.ndarray, near: np.ndarray, others: np.ndarray, worst, sums, total, s, q) -> None:
        """Go on with sets of ``a`` and ``others`` (places in rest) by each later row."""
        n, k = others.shape[1] + 1, self.k
        if n == k:
            self.last(np.concatenate([np.full((len(others), 1), a), rest[others]], 1))
            return
        few = max(1, HELD // len(rest))
        for at in range(0, len(others), few):
            x = slice(at, at + few)
            now, start = others[x], int(others[x, -1].min()) + 1
            left = np.concatenate([v[now[:, -1]], np.full((len(now), 1), -(k - n) / k, "float32")], 1)
            most = (total[x] / k + 2 - self.floor + self.slack).astype("float32")
            at_, more = _places(left @ right[:, start:] <= most[:, None], start)
            ok = (more > now[at_, -1]) & (near[more] <= most[at_] + (k - n) / k * right[-1, more] + self.slack)
            at_, more = at_[ok], more[ok]
            high, sum_ = np.maximum(worst[x][at_], near[more]), near[more] + sums[x][at_]
            for p in range(n - 1):
                cos = _cosines(v, now[at_, p], more)
                high, sum_ = np.maximum(high, cos), sum_ + cos
            own = rest[more]
            m, lum = self.cols["match"][own], self.cols["lum01"][own]
            one = (total[x][at_] + m, m, high, sum_, s[x][at_] + lum, q[x][at_] + lum**2)
            ok = self.reach(n + 1, *one)
            for p in range(n - 1):
                ok &= self.fit(rest[now[at_, p]], own)
            total_, _, worst_, sums_, s_, q_ = (y[ok] for y in one)
            self.sets(a, rest, v, right, near, np.concatenate([now[at_[ok]], more[ok, None]], 1), worst_, sums_, total_, s_, q_)

    def last(self, sets: np.ndarray) -> None:
        """Whole sets, measured in double precision; the floor rises by them."""
        c, k = self.cols, self.k
        for ids in sets.tolist():
            v, lum = self.v[ids], c["lum01"][ids]
            worst = float((v @ v.T)[np.triu_indices(k, 1)].max())
            value = float(c["match"][ids].sum() / k + 1 - worst + _even(lum.sum(), (lum * lum).sum(), k, k))
            if worst <= self.limit and value >= self.floor and _dealt(tuple(sorted(c["mask"][ids].tolist()))):
                self.found.append((value, ids, worst))
                self.floor = max(self.floor, value - 1e-8)  # sets that are equal to nine digits are kept


def _sets(rows: DataFrame, k: int, least: float, size: float, sim_limit: float, floor: float, parts: int, may: Column) -> DataFrame:
    """Feasible sets (value, ids, masks, worst, m, s, q) with the best one among those whose best match ``may`` be it, each found by the task that has this row."""

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by([("match", "descending"), ("idx", "ascending")]).combine_chunks()
        v = t.column("v").combine_chunks()
        v = v.values.to_numpy().reshape(len(v), -1) if len(v) else np.empty((0, 1))
        c = {x: t.column(x).to_numpy() for x in ("idx", "match", "lum01", "cluster_id", "mask", "first")}
        todo = _Search(v, c, k, least, size, sim_limit, floor)
        todo.first(np.flatnonzero(c["first"]))
        out = {"value": [], "ids": [], "masks": [], "worst": [], "m": [], "s": [], "q": []}
        for value, at, worst in todo.found:
            if value >= todo.floor:
                at = sorted(at, key=lambda x: c["idx"][x])
                lum = c["lum01"][at]
                for name, x in zip(out, (value, c["idx"][at].tolist(), c["mask"][at].tolist(), worst, float(c["match"][at].sum()), float(lum.sum()), float((lum * lum).sum())), strict=True):
                    out[name].append(x)
        kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.float64()] * 4]
        return pa.table({name: pa.array(x, kind) for (name, x), kind in zip(out.items(), kinds, strict=True)})

    part = F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int")
    first = (F.col("part") == F.col("own")) & (F.col("match") + 2 - least >= floor) & may
    dealt = rows.withColumn("own", part).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("first", first.cast("int")).drop("own")
    return dealt.groupBy("part").applyInArrow(search, "value double, ids array<long>, masks array<int>, worst double, m double, s double, q double")


def best_assignment(df: DataFrame, slots: list[str], threshold: float = 0.25, sim_limit: float = 0.82, width: int = 256, block: int = BLOCK) -> DataFrame:
    """seq (idx by slot) and total of the best feasible set; no row if there is none.

    df has idx, v (of any length, not above 1), match, lum01, cluster_id (below 0:
    none) and fit_<slot>. The result doesn't depend on ``width`` or ``block``.
    """
    k = len(slots)
    fit = [F.coalesce(F.col(f"fit_{s}") >= threshold, F.lit(False)).cast("int") * (1 << j) for j, s in enumerate(slots)]
    rows = df.select("idx", "v", "match", "lum01", F.col("cluster_id").cast("long").alias("cluster_id"), sum(fit, F.lit(0)).alias("mask")).where("mask > 0").na.drop()
    rows = materialised(rows, "rows")
    top = rows.agg(F.max("match").alias("match"), F.max(dot(F.col("v"), F.col("v"))).alias("size"), F.count("*").alias("n")).first()
    empty = df.sparkSession.createDataFrame([], "seq array<long>, total double")
    if top["match"] is None:
        return empty
    most = float(top["match"])
    least = -max(1.0, float(top["size"])) / (k - 1)  # of k vectors two are at least so much alike
    size = max(1.0, float(top["size"]))
    floor = beam_value(rows, k, most, least, sim_limit, width) - EPS
    parts = min(PARTS, -(-int(top["n"]) // block))
    # the sets of the rows with the best match come first, as their best one is a floor for the search of all others
    rounds = [F.lit(True)]
    if top["n"] > 4 * LEAD:
        lead = rows.orderBy(F.desc("match")).limit(LEAD).agg(F.min("match")).first()[0]
        rounds = [F.col("match") >= lead, F.col("match") < lead]
    found = []
    for may in rounds:
        # a set that is good enough may hold these rows at most
        rows1 = rows.where((F.col("match") + (k - 1) * most) / k + 2 - least >= floor)
        found.append(materialised(_sets(rows1, k, least, size, sim_limit, floor, parts, may), "sets"))
        best = found[-1].agg(F.max("value")).first()[0]
        floor = max(floor, -np.inf if best is None else best - 1e-8)
    state = reduce(DataFrame.unionByName, found).where(F.col("value") >= floor)
    orders = "array(" + ", ".join(f"array({', '.join(map(str, p))})" for p in permutations(range(k))) + ")"
    # orders are sorted and ids ascend, so the first that fits is the smallest sequence
    whole = state.withColumn("o", F.expr(f"filter({orders}, o -> forall(sequence(0, {k - 1}), j -> shiftright(masks[o[j]], j) % 2 = 1))")).where("size(o) > 0")
    seq = F.expr("transform(o[0], p -> ids[p])").alias("seq")
    out = materialised(whole.select(seq, (_bound(k, k, most, -1e9) / 3).alias("total")).orderBy(F.desc(F.round("total", 9)), "seq").limit(1), "best")
    forget(rows, *found)
    return out
