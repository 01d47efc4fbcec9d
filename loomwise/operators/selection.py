"""Ordered selections from a pool: fronts, beams, dynamic programming and greedy slots.

Each step is a scan of the rows with one row of state, or a join of a few states
with them; where a sequencer states a pool, it is bounded by the top scores
(``top``). Ties go to the smaller idx, so that results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwise.functions.vectors import dot
from loomwise.operators.similarity import _paired, block_rows
from loomwise.operators.skyline import skyline
from loomwise.session import cut, materialised

#: Weights (composition, human, mood, diversity) of the narrative roles.
ROLES = {
    "opener": (0.4, 0.1, 0.3, 0.2),
    "subject": (0.2, 0.5, 0.1, 0.2),
    "detail": (0.5, 0.1, 0.2, 0.2),
    "contrast": (0.2, 0.2, 0.4, 0.2),
    "closer": (0.3, 0.1, 0.5, 0.2),
}
#: Weights (semantic, personal, diversity) of the three-objective roles.
ROLES3 = {
    "opener": (0.30, 0.30, 0.40),
    "subject": (0.40, 0.40, 0.20),
    "detail": (0.35, 0.25, 0.40),
    "contrast": (0.25, 0.25, 0.50),
    "closer": (0.35, 0.35, 0.30),
}
EPS = 1e-9
#: Pairs of rows that a task compares at once.
PAIRS = 1 << 20
#: Rows from which on all pairs are compared once for bounds before sequences are searched.
MANY = 4096


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows, with their lineage cut: they are read once a step."""
    return cut(df.orderBy(F.desc(score), "idx").limit(k))


def _beaten(a: str, b: str, cols: list[str]) -> Column:
    """Row a is at least as good as row b everywhere and better somewhere, within EPS."""
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in cols]
    return reduce(lambda x, y: x & y, [x >= -EPS for x in d]) & reduce(lambda x, y: x | y, [x > EPS for x in d])


def _front_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """The front of a bounded pool by a plain anti join."""
    return df.alias("b").join(F.broadcast(df.select(*cols)).alias("a"), _beaten("a", "b", cols), "left_anti").select("b.*")


def role_fit(w: tuple[float, ...]) -> Column:
    return F.col("comp") * w[0] + F.col("human") * w[1] + F.col("light") * w[2]


def pareto_sequence(df: DataFrame, target: int = 5, budget: int = 300, roles: dict = ROLES) -> list:
    """One row a slot: the best weighted member of the five-objective front; df has v, exif_ts and event too."""
    picked, used = [], []
    for slot, (name, w) in enumerate(list(roles.items())[:target]):
        pool = df.where(~F.col("idx").isin(used)) if used else df
        pool = pool.orderBy(F.desc("score"), "idx").limit(budget)
        if picked:
            last = picked[-1]
            gap = F.abs(F.col("exif_ts") - last["exif_ts"])
            widest = F.broadcast(pool.agg(F.max(gap).alias("_g")))
            pool = pool.crossJoin(widest)
            div = F.least(F.greatest(0.5 - dot(F.col("v"), F.lit(list(last["v"]))) * 0.5, F.lit(0.0)), F.lit(1.0))
            time = 1.0 - gap / F.when(F.col("_g") > 0, F.col("_g")).otherwise(1.0)
            event = F.when(F.col("event") != last["event"], 0.3).otherwise(0.0)
        else:
            div, time, event = F.lit(0.5), F.lit(0.5), F.lit(0.3)
        obj = {"o_role": role_fit(w), "o_qual": F.col("score"), "o_div": div, "o_time": time, "o_event": event}
        front = _front_of(cut(pool.withColumns(obj)), list(obj))
        raw = [w[0] * 0.8 + 0.10, 0.25, w[3], 0.10, 0.10]
        value = sum((F.col(o) * (x / sum(raw)) for o, x in zip(obj, raw, strict=True)), F.lit(0.0))
        row = front.withColumn("value", value).orderBy(F.desc("value"), "idx").withColumn("slot", F.lit(name)).withColumn("pos", F.lit(slot)).first()
        if row is None:
            break
        picked.append(row)
        used.append(row["idx"])
    return picked


def pareto3_sequence(df: DataFrame, target: int = 5) -> list:
    """One row a slot from the front of semantic, personal and diversity."""
    picked = []
    for slot, (name, w) in enumerate(list(ROLES3.items())[:target]):
        pool = df.where(~F.col("idx").isin([r["idx"] for r in picked])) if picked else df
        worst = F.greatest(*[dot(F.col("v"), F.lit(list(r["v"]))) for r in picked]) if len(picked) > 1 else dot(F.col("v"), F.lit(list(picked[0]["v"]))) if picked else None
        div = F.lit(0.5) if worst is None else F.least(F.greatest(1.0 - worst, F.lit(0.0)), F.lit(1.0))
        obj = {"o_sem": F.col("semantic"), "o_pers": F.col("personal"), "o_div": div}
        front = skyline(pool.withColumns(obj), list(obj))
        value = sum((F.col(o) * (x / sum(w)) for o, x in zip(obj, w, strict=True)), F.lit(0.0))
        row = front.withColumn("value", value).orderBy(F.desc("value"), "idx").withColumn("slot", F.lit(name)).withColumn("pos", F.lit(slot)).first()
        if row is None:
            break
        picked.append(row)
    return picked


def as_frame(df: DataFrame, rows: list, columns: dict[str, str]) -> DataFrame:
    """A DataFrame of a few picked rows with the named columns and types."""
    return df.sparkSession.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {t}" for c, t in columns.items()))


def beam(df: DataFrame, target: int = 5, width: int = 4, roles: dict = ROLES) -> DataFrame:
    """The ``width`` best sequences (seq, total): each step extends every state by every unused row."""
    names = list(roles)
    state = df.orderBy(F.desc("score"), "idx").limit(width).select(F.array("idx").alias("seq"), F.col("score").alias("total"), F.col("v").alias("last"))
    for step in range(1, target):
        w = roles[names[min(step, len(names) - 1)]]
        flow = 1.0 - F.abs((dot(F.col("last"), F.col("v")) + 1.0) / 2.0 - 0.55)
        gain = F.col("score") * 0.40 + role_fit(w) * 0.30 + flow * 0.30
        grown = df.crossJoin(F.broadcast(state)).where(~F.array_contains("seq", F.col("idx")))
        state = grown.select(F.concat("seq", F.array("idx")).alias("seq"), (F.col("total") + gain).alias("total"), F.col("v").alias("last")).orderBy(F.desc("total"), "seq").limit(width)
    return state.select("seq", "total")


#: Street slots: weights of the dimensions, and a penalty unless a condition holds.
SLOT_FIT = [
    ({"comp": 0.50, "tech": 0.25, "narr": 0.25}, "comp >= 0.40", 0.15),
    ({"human": 0.45, "narr": 0.35, "light": 0.20}, "human >= 0.35 OR narr >= 0.50", 0.20),
    ({"tech": 0.45, "comp": 0.35, "narr": 0.20}, "tech >= 0.38", 0.10),
    ({"light": 0.50, "comp": 0.30, "human": 0.20}, "true", 0.15),
    ({"narr": 0.40, "light": 0.35, "comp": 0.25}, "light >= 0.40", 0.10),
]


def _slot_fit(slot: int) -> Column:
    w, need, penalty = SLOT_FIT[slot]
    fit = sum((F.col(c) * x for c, x in w.items()), F.lit(0.0))
    return F.when(F.expr(need), fit).otherwise(F.greatest(F.lit(0.0), fit - penalty))


def _classed(rows: DataFrame, by: str, n: int, block: int, up: bool) -> tuple[DataFrame, list]:
    """rows with place, their block, and a row for each class of values of ``by``, in order: least, most and blocks up to its end.

    Quantiles cut the values into classes, 256 at most, and each class is dealt into
    blocks of about ``block`` rows; blocks are numbered from class to class.
    """
    classes = max(1, min(256, -(-n // block)))
    marks = rows.select(F.percentile_approx(by, [k / classes for k in range(1, classes)], 100 * classes)).first()[0] if classes > 1 else None
    marks = F.array(*map(F.lit, sorted(set(marks or [])))).cast("array<double>")
    at = F.size(F.filter(marks, (lambda m: m <= F.col(by)) if up else (lambda m: m > F.col(by))))
    rows = rows.withColumn("class", at)
    sizes = sorted(rows.groupBy("class").agg(F.min(by).alias("least"), F.max(by).alias("most"), F.ceil(F.count("*") / (1.1 * block)).cast("int").alias("n")).collect())  # a row a class
    ends = np.cumsum([r["n"] for r in sizes]).tolist()
    table = rows.sparkSession.createDataFrame([(r["class"], e - r["n"], r["n"], k) for k, (r, e) in enumerate(zip(sizes, ends, strict=True))], "class int, first int, blocks int, rank int")
    placed = rows.join(F.broadcast(table), "class").withColumn("place", F.col("first") + F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"))
    return placed.drop("class", "first", "blocks"), [(r["least"], r["most"], e) for r, e in zip(sizes, ends, strict=True)]


def _bonus(sims, near, light, weights: tuple[float, float, float], n_valid: int):
    """What two rows next to each other bring, by their cosine and how far apart their places and lights are."""
    flow, div, time = weights
    return sims * flow + (1.0 - sims) * div + (1.0 - near / max(n_valid - 1, 1)) * time + light * 0.05


def _most_bonus(df: DataFrame, weights: tuple[float, float, float], n_valid: int, block: int | None) -> DataFrame:
    """idx and most, the largest bonus of a row with any other, in single precision: each pair of rows is compared once, in twelve blocks."""

    def each(t: pa.Table) -> pa.Table:
        side = []
        for is_left in (True, False):
            x = t.filter(pc.equal(t.column("is_left"), is_left)).combine_chunks()
            v = x.column("v").combine_chunks()
            side.append((v.values.to_numpy().reshape(len(x), -1) if len(x) else np.empty((0, 1), "float32"), *(x.column(c).to_numpy().astype(k) for c, k in (("pos", "float32"), ("light", "float32"), ("id", "int64")))))
        (v, pos, light, idx), (w, p_pos, p_light, p_idx) = side
        if not len(v) or not len(w):
            return pa.table({"idx": pa.array([], pa.int64()), "most": pa.array([], pa.float32())})
        same = t.column("p")[0] == t.column("q")[0]
        top, p_top = np.full(len(v), -np.inf, "float32"), np.full(len(w), -np.inf, "float32")
        # weights go into the rows, and a block is worked on where it lies, as passes over it take most of the time
        flow, div, time = weights
        far, v = np.float32(abs(time) / max(n_valid - 1, 1)), v * np.float32(flow - div)
        pos, p_pos, light, p_light = pos * far, p_pos * far, light * np.float32(0.05), p_light * np.float32(0.05)
        add = np.subtract if time >= 0 else np.add
        held = np.empty((2, 256 * 1024), "float32")
        for a in range(0, len(v), 256):
            i = slice(a, a + 256)
            for b in range(0, len(w), 1024):
                j = slice(b, b + 1024)
                shape = (len(pos[i]), len(p_pos[j]))
                found, apart = (x[: shape[0] * shape[1]].reshape(shape) for x in held)
                np.matmul(v[i], w[j].T, out=found)
                for x, y, put in ((pos, p_pos, add), (light, p_light, np.add)):
                    np.abs(np.subtract(x[i, None], y[j], out=apart), out=apart)
                    put(found, apart, out=found)
                if same:  # rows of an idx are in one block
                    found[idx[i, None] == p_idx[j]] = -np.inf
                np.maximum(top[i], found.max(1), out=top[i])
                np.maximum(p_top[j], found.max(0), out=p_top[j])
        top, p_top = top + np.float32(div + time), p_top + np.float32(div + time)
        return pa.table({"idx": np.concatenate([idx, p_idx]), "most": np.concatenate([top, p_top])})

    rows = df.select(F.col("idx").alias("id"), F.col("v").cast("array<float>").alias("v"), F.col("pos").cast("double").alias("pos"), F.col("light").cast("double").alias("light"))
    return _paired(rows, block, blocks=12).groupBy("p", "q").applyInArrow(each, "idx long, most float").groupBy("idx").agg(F.max("most").cast("double").alias("most"))


def _may_lead(df: DataFrame, own: list[Column], weights: tuple[float, float, float], n_valid: int, size: float, leaders: int, block: int | None) -> DataFrame:
    """The rows that can be in a best assignment.

    A step brings no more than the mean of what its two rows can bring at most, so a
    row in a slot has a bound: its own value and its share of the steps beside it,
    with the largest such values of all other slots. The best assignment of the
    ``leaders`` of each slot, by these values, is a floor; rows below it in all slots go.
    """
    k = len(own)
    steps = [(s > 0) / 2 + (s < k - 1) / 2 for s in range(k)]
    rows = df.join(_most_bonus(df, weights, n_valid, block), "idx")
    rows = materialised(rows.select("idx", "pos", "v", "light", *[x.alias(f"x{s}") for s, x in enumerate(own)], *[(x + F.col("most") * steps[s]).alias(f"f{s}") for s, x in enumerate(own)]), "bounds")
    lead = reduce(DataFrame.unionByName, [rows.orderBy(F.desc(f"f{s}"), "pos").limit(leaders) for s in range(k)]).toPandas().drop_duplicates("pos")  # ``leaders`` rows a slot
    if lead.empty:
        return df
    v, pos, light, idx = (np.stack(lead["v"].to_numpy()), *(lead[c].to_numpy() for c in ("pos", "light", "idx")))
    step = _bonus(v @ v.T, np.abs(pos[:, None] - pos), np.abs(light[:, None] - light), weights, n_valid)
    step[idx[:, None] == idx] = -np.inf
    total = lead["x0"].to_numpy()
    for s in range(1, k):
        total = (step + total).max(1) + lead[f"x{s}"].to_numpy()
    most = rows.agg(*[F.max(f"f{s}") for s in range(k)]).first()
    floor = float(total.max()) - 1e-5 * max(1.0, size)
    may = reduce(lambda a, b: a | b, [F.col(f"f{s}") + (sum(most) - most[s]) >= floor for s in range(k)])
    return materialised(df.join(rows.where(may).select("idx"), "idx", "left_semi"), "rows")


def viterbi(df: DataFrame, flow: float, div: float, time: float, n_valid: int, target: int = 5, block: int | None = None, leaders: int = 64, seen: list | None = None) -> DataFrame:
    """The best assignment of rows to slots (seq, total); neighbours differ, later repeats are allowed.

    df has pos, the place among all valid rows. From MANY rows on, all pairs are
    compared once in single precision, which leaves the rows that a best assignment
    may hold; the rest is done with these.

    In each slot every row looks for its best predecessor. The ``leaders``, the rows
    with the largest totals, give each row a floor that its best reaches. A predecessor whose total with the largest
    possible bonus is below a row's floor can't be its best; so rows are classed by
    floor and predecessors by total, and only classes that can matter to each other
    meet, in pairs of blocks that are one group each; a table has twelve blocks, of
    BLOCK rows at least, so that its copies grow as it does. ``seen`` gets the pairs compared
    and all pairs of each slot. Ties go to the smaller place.
    """
    own = lambda s: (_slot_fit(s) * 0.25 + F.col("score") * 0.10).alias("x")

    def bonus(sims, near, light):
        return _bonus(sims, near, light, (flow, div, time), n_valid)

    def best(g: pd.DataFrame) -> pd.DataFrame:
        now, last = g[g["is_now"]], g[~g["is_now"]].sort_values("pos")
        if now.empty or last.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("idx", "int64"), ("total", float), ("before", "int64"), ("o", "int64"))})
        v, w = np.stack(now["v"].to_numpy()), np.stack(last["v"].to_numpy()).T
        j, top, few = np.empty(len(now), np.int64), np.empty(len(now)), max(1, PAIRS // len(last))
        for a in range(0, len(now), few):
            at = lambda c, a=a: (now[c].to_numpy()[a : a + few, None], last[c].to_numpy()[None, :])
            (x, old), (pos, p_pos), (light, p_light), (idx, p_idx) = (at(c) for c in ("x", "pos", "light", "idx"))
            step = old + x + bonus(v[a : a + few] @ w, np.abs(p_pos - pos), np.abs(light - p_light))
            step[idx == p_idx] = -np.inf
            j[a : a + few] = step.argmax(1)
            top[a : a + few] = step.max(1)
        out = pd.DataFrame({"idx": now["idx"].to_numpy(), "total": top, "before": last["idx"].to_numpy()[j], "o": -last["pos"].to_numpy()[j]})
        return out[np.isfinite(top)]

    cols = ["idx", "pos", "v", "light", "x"]
    limits = df.agg(F.max(dot(F.col("v"), F.col("v"))).alias("size"), (F.max("light") - F.min("light")).alias("light"), F.count("*").alias("n")).first()
    if limits["n"] >= MANY:
        df = _may_lead(df, [own(s) for s in range(target)], (flow, div, time), n_valid, limits["size"], leaders, block)
    state = cut(df.select("idx", "pos", F.array("idx").alias("seq"), own(0).alias("total")))
    if limits["size"] is None:
        return state.select("seq", "total")
    most = div + limits["size"] * abs(flow - div) + max(time, 0.0) + 0.05 * limits["light"] + 1e-9
    for s in range(1, target):
        last = materialised(df.select("idx", "pos", "v", "light").join(state.select("idx", F.col("total").alias("x")), "idx"), "last")
        lead = last.orderBy(F.desc("x"), "pos").limit(leaders).toPandas()  # ``leaders`` rows
        if lead.empty:
            return state.select("seq", "total").limit(0)

        def floors(batches, lead=lead):
            v, old, pos, light, idx = (np.stack(lead["v"].to_numpy()), *(lead[c].to_numpy() for c in ("x", "pos", "light", "idx")))
            for b in batches:
                if len(b):
                    step = old + bonus(np.stack(b["v"].to_numpy()) @ v.T, np.abs(b["pos"].to_numpy()[:, None] - pos), np.abs(b["light"].to_numpy()[:, None] - light))
                    step[b["idx"].to_numpy()[:, None] == idx] = -np.inf
                    yield b.assign(floor=np.maximum(step.max(1) - 1e-9, -1e300))

        kinds = ", ".join(f"{c} {t}" for c, t in df.select(*cols[:-1], own(s)).dtypes)
        now = materialised(df.select(*cols[:-1], own(s)).mapInPandas(floors, f"{kinds}, floor double"), "now")
        n, n_now = last.count(), now.count()
        now, lows = _classed(now, "floor", n_now, block or block_rows(n_now, 12), True)
        old, highs = _classed(last, "x", n, block or block_rows(n, 12), False)
        # of each class of rows the classes of predecessors that reach its least floor, the first ones; and the other way round
        needs = [sum(high + most >= low for _, high, _ in highs) for low, _, _ in lows]
        upto = [highs[k - 1][2] if k else 0 for k in needs]
        back = [max((e for (_, _, e), k in zip(lows, needs, strict=True) if k > q), default=0) for q in range(len(highs))]
        if seen is not None:
            seen.append((sum(u * (e - b) for u, (_, _, e), b in zip(upto, lows, [0, *(e for _, _, e in lows[:-1])], strict=True)), highs[-1][2] * lows[-1][2]))
        of = lambda ends: F.get(F.array(*map(F.lit, ends)), F.col("rank"))
        spread = lambda rows, ends: rows.where(of(ends) > 0).withColumn("other", F.explode(F.sequence(F.lit(0), of(ends) - 1)))
        one = spread(now, upto).select(*cols, F.lit(True).alias("is_now"), F.col("place").alias("p"), F.col("other").alias("q"))
        two = spread(old, back).select(*cols, F.lit(False).alias("is_now"), F.col("other").alias("p"), F.col("place").alias("q"))
        found = one.unionByName(two).groupBy("p", "q").applyInPandas(best, "idx long, total double, before long, o long")
        won = found.groupBy("idx").agg(F.max(F.struct("total", "o", "before")).alias("m")).select("idx", "m.*")
        before = state.select(F.col("idx").alias("before"), "seq")
        state = cut(won.join(before, "before").select("idx", F.concat("seq", F.array("idx")).alias("seq"), "total").join(df.select("idx", "pos"), "idx"))
    return state.orderBy(F.desc("total"), "pos").limit(1).select("seq", "total")


def without_repeats(best: DataFrame, df: DataFrame) -> DataFrame:
    """A sequence of a few frames (seq) whose repeats are replaced by the best rows that it doesn't hold, by score."""
    flat = best.select(F.explode("seq").alias("idx")).distinct()
    spare = df.select("idx", "score").join(F.broadcast(flat), "idx", "left_anti").orderBy(F.desc("score"), "idx").limit(10)
    spare = spare.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "idx"))), lambda x: x.idx).alias("spare"))
    again = lambda i: F.array_contains(F.slice("seq", F.lit(1), i), F.get("seq", i))
    # how many repeats come before place i says which spare row it gets
    before = lambda i: F.size(F.filter(F.sequence(F.lit(0), i), again)) - 1
    fixed = F.transform("seq", lambda x, i: F.when(again(i), F.get("spare", before(i))).otherwise(x))
    return best.crossJoin(F.broadcast(spare)).withColumn("seq", F.filter(fixed, lambda x: x.isNotNull())).drop("spare")


def assign_roles(df: DataFrame, target: int = 5, roles: dict = ROLES) -> list:
    """One row a role: the best score first, then role fit, difference from the last frame and score."""
    picked = []
    for slot, (name, w) in enumerate(list(roles.items())[:target]):
        pool = df.where(~F.col("idx").isin([r["idx"] for r in picked])) if picked else df
        value = F.col("score") if not picked else role_fit(w) * 0.6 + (1.0 - dot(F.lit(list(picked[-1]["v"])), F.col("v"))) * w[3] + F.col("score") * 0.2
        row = pool.withColumn("value", value).orderBy(F.desc("value"), F.desc("score"), "idx").withColumn("slot", F.lit(name)).withColumn("pos", F.lit(slot)).first()
        if row is None:
            break
        picked.append(row)
    return picked


def assign_roles_by(df: DataFrame, by: list[str], roles: dict = ROLES) -> DataFrame:
    """by, pos, slot, idx and value: :func:`assign_roles` for every group at once, a round a role.

    A round is one aggregate by group of the rows not yet taken, so no group is gathered.
    """
    left, picked, state = df, None, None
    for slot, (name, w) in enumerate(roles.items()):
        value = F.col("score") if state is None else role_fit(w) * 0.6 + (1.0 - dot(F.col("_last"), F.col("v"))) * w[3] + F.col("score") * 0.2
        pool = left if state is None else left.join(state, by)
        row = F.struct(value.alias("value"), "score", (-F.col("idx")).alias("o"), "idx", "v")
        now = materialised(pool.groupBy(*by).agg(F.max(row).alias("m")).select(*by, F.lit(slot).alias("pos"), F.lit(name).alias("slot"), "m.idx", "m.value", F.col("m.v").alias("_last")), "roles")
        picked = now if picked is None else picked.unionByName(now)
        state = now.select(*by, "_last")
        left = df.join(picked.select(*by, "idx"), [*by, "idx"], "left_anti")
    return picked.drop("_last")


def greedy_slots(df: DataFrame, slots: list[str], thresholds: list[float], sim_limit: float = 0.82) -> list:
    """One row a slot under fitness, cluster and similarity limits; similarity alone may be relaxed.

    df has a fitness column fit_<slot>, match, lum01 and cluster_id. The value is that
    of the set so far: 0.4 mean match, 0.4 worst-pair diversity, 0.2 even light.
    """
    picked: list = []
    for pos, s in enumerate(slots):
        ok = F.col(f"fit_{s}") >= thresholds[pos]
        clusters = [r["cluster_id"] for r in picked if r["cluster_id"] >= 0]
        if picked:
            ok = ok & ~F.col("idx").isin([r["idx"] for r in picked])
        if clusters:
            ok = ok & ~F.col("cluster_id").isin(clusters)
        sims = [dot(F.lit(list(r["v"])), F.col("v")) for r in picked]
        old = max([float(np.dot(a["v"], b["v"])) for i, a in enumerate(picked) for b in picked[i + 1 :]], default=-2.0)
        worst = F.greatest(F.lit(old), *sims) if sims else F.lit(None).cast("double")
        n = len(picked) + 1
        match = (F.lit(float(sum(r["match"] for r in picked))) + F.col("match")) / n
        light = [r["lum01"] for r in picked]
        mean = (F.lit(float(sum(light))) + F.col("lum01")) / n
        var = (sum((F.pow(F.lit(float(x)) - mean, 2) for x in light), F.lit(0.0)) + F.pow(F.col("lum01") - mean, 2)) / n
        even = F.least(F.greatest(1.0 - F.sqrt(var) * 3.0, F.lit(0.0)), F.lit(1.0))
        value = 0.40 * match + 0.40 * (1.0 - worst if sims else F.lit(0.5)) + 0.20 * even
        pool = df.where(ok).withColumns({"worst": worst, "value": value}).withColumn("slot", F.lit(s)).withColumn("pos", F.lit(pos))
        first = pool.where(F.col("worst").isNull() | (F.col("worst") <= sim_limit)).orderBy(F.desc("value"), "idx").first()
        row = first or pool.orderBy(F.desc("value"), "idx").first()
        if row is None:
            raise ValueError(f"no candidate is left for slot {s}")
        picked.append(row)
    return picked


def lookahead(df: DataFrame, predicates: list[str | None], target: int = 5) -> DataFrame:
    """The best contact sheet: from every start, each slot takes the row most like the last one.

    Rows that meet the slot's predicate come first, any other only if none does. The
    total is 0.45 flow, 0.35 pacing and 0.20 tension. df is a pool of about twenty rows.
    """
    state = df.select(F.col("idx").alias("start"), F.array(F.struct("idx", "score", "tension")).alias("seq"), F.col("v").alias("last"), F.array().cast("array<double>").alias("_sims"))
    for slot in range(1, target):
        ok = F.expr(predicates[slot]) if predicates[slot] else F.lit(True)
        grown = df.withColumn("_ok", ok.cast("int")).crossJoin(F.broadcast(state)).where(~F.exists("seq", lambda x: x.idx == F.col("idx")))
        cos = dot(F.col("last"), F.col("v"))
        best = F.max(F.struct("_ok", cos.alias("cos"), (-F.col("idx")).alias("o"), F.struct("idx", "score", "tension").alias("row"), "v"))
        picked = grown.groupBy("start").agg(best.alias("b"), F.first("seq").alias("seq"), F.first("_sims").alias("_sims"))
        state = picked.select("start", F.concat("seq", F.array("b.row")).alias("seq"), F.col("b.v").alias("last"), F.concat("_sims", F.array("b.cos")).alias("_sims"))
    n = F.lit(float(target))
    add = lambda f: F.aggregate("seq", F.lit(0.0), lambda s, x: s + f(x))
    state = state.where(F.size("seq") == target).withColumn("_m", add(lambda x: x.score) / n)
    std = F.sqrt(F.aggregate("seq", F.lit(0.0), lambda s, x: s + F.pow(x.score - F.col("_m"), 2)) / n)
    flow = F.aggregate("_sims", F.lit(0.0), lambda s, x: s + x) / (target - 1)
    total = 0.45 * flow + 0.35 * (1.0 - std / F.greatest(std, F.lit(0.35))) + 0.20 * (add(lambda x: x.tension) / n)
    return state.select("start", F.transform("seq", lambda x: x.idx).alias("seq"), total.alias("total")).orderBy(F.desc("total"), "start").limit(1)


#: Weights of the editorial slots; the last takes the row least like those before.
EDITORIAL = [{"comp": 0.5, "tech": 0.3, "light": 0.2}, {"human": 0.5, "narr": 0.4, "comp": 0.1}, {"tech": 0.6, "comp": 0.3, "light": 0.1}, {"light": 0.6, "narr": 0.3, "comp": 0.1}, {}]
EDITORIAL_NAMES = ["Opening", "Human Moment", "Detail", "Mood", "Closing"]


def editorial(df: DataFrame) -> list:
    """One row a slot from the best 70 per cent (15 rows at least) by score."""
    n = df.count()
    pool = top(df, max(int(n * 0.7), 15))
    picked: list = []
    for slot, w in enumerate(EDITORIAL):
        free = pool.where(~F.col("idx").isin([r["idx"] for r in picked])) if picked else pool
        if w:
            value = sum((F.col(c) * x for c, x in w.items()), F.lit(0.0))
        else:
            value = 1.0 - F.least(*[dot(F.col("v"), F.lit(list(r["v"]))) for r in picked])
        row = free.withColumn("value", value).orderBy(F.desc("value"), F.desc("score"), "idx").withColumn("slot", F.lit(EDITORIAL_NAMES[slot])).withColumn("pos", F.lit(slot)).first()
        if row is None:
            break
        picked.append(row)
    return picked


def locked_slots(df: DataFrame, locks: DataFrame, avoid: DataFrame, slots: int = 5) -> DataFrame:
    """pos and path of each slot: locked paths in their places, the rest by score without locked and avoided paths."""
    spark = df.sparkSession
    places = spark.range(slots).select(F.col("id").cast("int").alias("pos")).join(F.broadcast(locks), "pos", "left")
    gaps = places.where("path IS NULL").withColumn("r", F.row_number().over(Window.orderBy("pos"))).select("pos", "r")
    free = df.join(locks.select("path"), "path", "left_anti").join(avoid.select("path"), "path", "left_anti").orderBy(F.desc("score"), "path").limit(slots)
    ranked = free.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "path"))).select("r", "path")
    return places.where("path IS NOT NULL").select("pos", "path").unionByName(gaps.join(ranked, "r").select("pos", "path"))


def _story(v: np.ndarray, score: np.ndarray, n_max: int, near: float) -> list[int]:
    """Rows of a story: one a role from orders by score and likeness to the centre, then the best blends."""
    if len(v) <= n_max:
        return list(range(len(v)))
    centre = v.mean(0)
    like = v @ (centre / (np.linalg.norm(centre) + 1e-9))
    by_score, down, up = (np.argsort(x, kind="stable") for x in (-score, -like, like))
    chosen: list[int] = []
    for order in (by_score, down, by_score, up, by_score):
        for i in order:
            if i not in chosen and (not chosen or (v[chosen] @ v[i]).max() <= near):
                chosen.append(int(i))
                break
    while len(chosen) < n_max:
        value = 0.60 * (1 - (v @ v[chosen].T).max(1)) + 0.40 * score
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


def _content_roles(v: np.ndarray, score: np.ndarray, apart: float, near: float) -> list[str]:
    names = ["opener", "subject", "detail", "contrast", "closer"]
    centre = v.mean(0)
    like = v @ (centre / (np.linalg.norm(centre) + 1e-9))
    by_score, up = np.argsort(-score, kind="stable"), np.argsort(like, kind="stable")
    role: dict[int, str] = {}

    def take(name, order, ok=lambda i: True):
        free = [int(i) for i in order if int(i) not in role]
        for i in [i for i in free if ok(i)] or free:
            role[i] = name
            return

    take("subject", by_score)
    take("opener", by_score, lambda i: like[i] <= apart)
    take("closer", by_score, lambda i: like[i] <= apart)
    take("contrast", up)
    take("detail", by_score, lambda i: (v[list(role)] @ v[i]).max() <= near)
    spare = iter(k for k in range(len(v)))
    return [role.get(i) or names[next(spare) % 5] for i in range(len(v))]


def _cinematic(role: list[str], score: np.ndarray, lum: np.ndarray, jump: float) -> list[int]:
    """Opener first, contrast in the middle, closer last, the rest by score; then up to three smoothing passes."""
    n, place = len(role), {}
    for name, at in (("opener", 0), ("closer", n - 1), ("contrast", n // 2)):
        mine = sorted((i for i in range(n) if role[i] == name and i not in place.values()), key=lambda i: -score[i])
        if mine and at not in place:
            place[at] = mine[0]
    rest = iter(sorted((i for i in range(n) if i not in place.values()), key=lambda i: -score[i]))
    order = [place[k] if k in place else next(rest) for k in range(n)]
    fixed = {0, n // 2, n - 1}
    for _ in range(3):
        moved = False
        for j in range(n - 2):
            if fixed & {j, j + 1, j + 2}:
                continue
            a, b, c = (lum[order[k]] for k in (j, j + 1, j + 2))
            if abs(a - b) > jump and abs(a - c) + abs(c - b) < abs(a - b) + abs(b - c) - 0.01:
                order[j + 1], order[j + 2] = order[j + 2], order[j + 1]
                moved = True
        if not moved:
            break
    return order


def story(df: DataFrame, n_max: int = 10, pool: int = 40, near: float = 0.88, apart: float = 0.70, jump: float = 0.25) -> DataFrame:
    """pos, idx, role and score of a story in cinematic order, from the ``pool`` best rows; one small group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "idx"], ascending=[False, True]).reset_index(drop=True)
        g = g.loc[_story(np.stack(g["v"].to_numpy()), g["score"].to_numpy(), n_max, near)].reset_index(drop=True)
        role = _content_roles(np.stack(g["v"].to_numpy()), g["score"].to_numpy(), apart, near)
        order = _cinematic(role, g["score"].to_numpy(), g["lum"].to_numpy() / 255, jump)
        return pd.DataFrame({"pos": range(len(order)), "idx": g["idx"].to_numpy()[order], "role": [role[i] for i in order], "score": g["score"].to_numpy()[order]})

    few = df.orderBy(F.desc("score"), "idx").limit(pool).select("idx", "v", "score", "lum")
    return few.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "pos int, idx long, role string, score double")


def portfolio_baseline(df: DataFrame, n: int = 5) -> DataFrame:
    """The n best by grade level and personal score."""
    return df.orderBy(F.desc("level"), F.desc("personal"), "idx").limit(n)


def _portfolio_value(a_sum, cos_sum, k: int):
    """Mean of what the rows bring and, for more than one, 1 less the mean cosine of their pairs."""
    return a_sum / k + (1 - cos_sum / (k * (k - 1) / 2) if k > 1 else 0)


def portfolio(df: DataFrame, n: int = 5) -> DataFrame:
    """idx, value and bound of a set of n rows with a large mean of score and personal and 1 less the mean cosine.

    All rows of the table are searched, each step by one scan whose tasks hand on
    their best row: greedy choice first, then the best exchange of one row for
    another until none makes the set better. No set is better than ``bound``: the n
    largest sums, and vectors as far apart as n vectors can be. Ties go to the
    smaller idx; rows with a null take no part.
    """
    rows = df.select(F.col("idx").cast("long").alias("idx"), "v", (F.col("score") + F.col("personal")).alias("a")).na.drop()
    rows = materialised(rows, "rows")

    def best(sets: list[list]) -> list:
        """For each set of rows the largest value with one row more, that row and its set's number."""
        k = len(sets[0]) + 1
        known = [([r["idx"] for r in s], np.array([r["v"] for r in s]), sum(r["a"] for r in s)) for s in sets]
        pairs = [float(np.triu(v @ v.T, 1).sum()) if len(v) else 0.0 for _, v, _ in known]

        def run(batches):
            for b in batches:
                if b.empty:
                    continue
                v, a, idx = np.stack(b["v"].to_numpy()), b["a"].to_numpy(), b["idx"].to_numpy()
                for number, ((ids, held, total), pair) in enumerate(zip(known, pairs, strict=True)):
                    value = _portfolio_value(total + a, pair + ((v @ held.T).sum(1) if len(held) else 0.0), k)
                    value = np.where(np.isin(idx, ids), -np.inf, value)
                    i = np.lexsort((idx, -np.round(value, 9)))[0]
                    if np.isfinite(value[i]):
                        yield pd.DataFrame({"number": [number], "value": [value[i]], "idx": [idx[i]], "v": [v[i]], "a": [a[i]]})

        found = rows.mapInPandas(run, "number int, value double, idx long, v array<double>, a double")
        top = F.min(F.struct((-F.round("value", 9)).alias("o"), "idx", "value", "v", "a")).alias("m")
        return found.groupBy("number").agg(top).select("number", "m.*").orderBy("number").collect()  # a row a set

    chosen: list = []
    while len(chosen) < n and (found := best([chosen])):
        chosen.append(found[0])
    value = chosen[-1]["value"] if chosen else 0.0
    while len(chosen) > 1:
        found = best([[r for r in chosen if r is not gone] for gone in chosen])
        new = min(found, key=lambda r: (-round(r["value"], 9), r["idx"]), default=None)
        if new is None or new["value"] <= value + 1e-9:
            break
        chosen[new["number"]], value = new, new["value"]
    most = rows.orderBy(F.desc("a"), "idx").limit(n).agg(F.avg("a").alias("a")).first()["a"]
    size = rows.agg(F.max(dot(F.col("v"), F.col("v"))).alias("s")).first()["s"]
    k = len(chosen)
    bound = (most + (1 + size / (k - 1) if k > 1 else 0)) if k else 0.0
    return df.sparkSession.createDataFrame([(r["idx"], float(value), float(bound)) for r in sorted(chosen, key=lambda r: r["idx"])], "idx long, value double, bound double")
