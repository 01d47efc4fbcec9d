"""Queries that pick ordered selections."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from loomwise.operators import assignment, scoring, selection, skyline, store, timeline
from loomwise.plans import grading
from loomwise.queries.grading import r6, s6

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


A = scoring.ASPECTS
G = grading.SQL


def pool(spark, d, k: int | None = None):
    """All graded rows with their lineage cut, or where a sequencer states a pool the k best."""
    g = grading.graded(spark, d).withColumn("cluster_id", F.col("idx") % 40 - 20)
    return selection.cut(g) if k is None else selection.top(g, k)


def P(k: int | None = None) -> str:
    return f"{G}, p AS (SELECT *, idx % 40 - 20 AS cluster_id FROM g" + (")" if k is None else f" ORDER BY score DESC, idx LIMIT {k})")


def _beats(a: str, b: str, cols) -> str:
    return "(" + " AND ".join(f"{a}.{c} - {b}.{c} >= -1e-9" for c in cols) + ") AND (" + " OR ".join(f"{a}.{c} - {b}.{c} > 1e-9" for c in cols) + ")"


@query("pareto_front", f"{G} SELECT idx, {s6('score', 'comp', 'human')} FROM g b WHERE NOT EXISTS (SELECT 1 FROM g a WHERE {_beats('a', 'b', ['score', 'comp', 'human'])})")
def pareto_front(spark, d):
    return skyline.skyline(grading.graded(spark, d).select("idx", "score", "comp", "human"), ["score", "comp", "human"]).select("idx", *r6("score", "comp", "human"))


def _role(w) -> str:
    return f"(comp * CAST({w[0]} AS DOUBLE) + human * CAST({w[1]} AS DOUBLE) + light * CAST({w[2]} AS DOUBLE))"


def _pareto_sql() -> str:
    out = f"{P(300)}, ev AS (SELECT *, sum(st) OVER (ORDER BY exif_ts, idx) AS event FROM (SELECT *, CASE WHEN exif_ts - lag(exif_ts) OVER (ORDER BY exif_ts, idx) > 900 THEN 1 ELSE 0 END AS st FROM p))"
    cols = ["o1", "o2", "o3", "o4", "o5"]
    for k, (name, w) in enumerate(selection.ROLES.items()):
        raw = [w[0] * 0.8 + 0.10, 0.25, w[3], 0.10, 0.10]
        if k:
            used = " AND ".join(f"ev.idx <> (SELECT idx FROM s{j})" for j in range(k))
            out += f""", o{k} AS (SELECT ev.*, {_role(w).replace("comp", "ev.comp").replace("human", "ev.human").replace("light", "ev.light")} AS o1, ev.score AS o2, least(greatest(0.5 - list_inner_product(ev.v, l.v) * 0.5, 0.0), 1.0) AS o3,
 1.0 - abs(ev.exif_ts - l.exif_ts) / CASE WHEN max(abs(ev.exif_ts - l.exif_ts)) OVER () > 0 THEN max(abs(ev.exif_ts - l.exif_ts)) OVER () ELSE 1.0 END AS o4, CASE WHEN ev.event <> l.event THEN 0.3 ELSE 0.0 END AS o5 FROM ev, s{k - 1} l WHERE {used})"""
        else:
            out += f", o0 AS (SELECT *, {_role(w)} AS o1, score AS o2, 0.5 AS o3, 0.5 AS o4, 0.3 AS o5 FROM ev)"
        value = " + ".join(f"{c} * CAST({x / sum(raw)!r} AS DOUBLE)" for c, x in zip(cols, raw, strict=True))
        out += f", f{k} AS (SELECT *, {value} AS value FROM o{k} b WHERE NOT EXISTS (SELECT 1 FROM o{k} a WHERE {_beats('a', 'b', cols)})), s{k} AS (SELECT * FROM f{k} ORDER BY value DESC, idx LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS pos, '{n}' AS slot, idx, round(value, 6) AS value FROM s{k}" for k, n in enumerate(selection.ROLES))


OUT = {"pos": "int", "slot": "string", "idx": "long", "value": "double"}


@query("pareto_sequence", _pareto_sql())
def pareto_sequence(spark, d):
    df = selection.cut(timeline.events_by_range(pool(spark, d, 300), id_="idx"))
    return selection.as_frame(df, selection.pareto_sequence(df), OUT).withColumn("value", F.round("value", 6))


def _pareto3_sql() -> str:
    out = f"{P()}, q AS (SELECT v AS qv FROM u WHERE id = 0), ev AS (SELECT p.*, least(greatest((list_inner_product(v, qv) + 1.0) / 2.0, 0.0), 1.0) AS semantic FROM p, q)"
    cols = ["o1", "o2", "o3"]
    for k, w in enumerate(selection.ROLES3.values()):
        if k:
            sims = ", ".join(f"list_inner_product(v, (SELECT v FROM s{j}))" for j in range(k))
            used = " AND ".join(f"idx <> (SELECT idx FROM s{j})" for j in range(k))
            out += f", o{k} AS (SELECT *, semantic AS o1, personal AS o2, least(greatest(1.0 - greatest({sims}), 0.0), 1.0) AS o3 FROM ev WHERE {used})"
        else:
            out += ", o0 AS (SELECT *, semantic AS o1, personal AS o2, 0.5 AS o3 FROM ev)"
        value = " + ".join(f"{c} * CAST({x / sum(w)!r} AS DOUBLE)" for c, x in zip(cols, w, strict=True))
        out += f", f{k} AS (SELECT *, {value} AS value FROM o{k} b WHERE NOT EXISTS (SELECT 1 FROM o{k} a WHERE {_beats('a', 'b', cols)})), s{k} AS (SELECT * FROM f{k} ORDER BY value DESC, idx LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS pos, '{n}' AS slot, idx, round(value, 6) AS value FROM s{k}" for k, n in enumerate(selection.ROLES3))


@query("pareto3_sequence", _pareto3_sql())
def pareto3_sequence(spark, d):
    from loomwise.plans import items

    q = items.units(spark, d).where("id = 0").select(F.col("v").alias("qv"))
    sem = F.least(F.greatest((selection.dot(F.col("v"), F.col("qv")) + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0))
    df = selection.cut(pool(spark, d).crossJoin(F.broadcast(q)).withColumn("semantic", sem))
    return selection.as_frame(df, selection.pareto3_sequence(df), OUT).withColumn("value", F.round("value", 6))


def beam_steps() -> str:
    """CTEs b0 to b4, the states of the beam over the rows of p."""
    out = ", b0 AS (SELECT [idx] AS seq, score AS total, v AS last FROM p ORDER BY score DESC, idx LIMIT 4)"
    for k, w in enumerate(list(selection.ROLES.values())[1:], 1):
        gain = f"score * CAST(0.40 AS DOUBLE) + {_role(w)} * 0.30 + (1.0 - abs((list_inner_product(last, v) + 1.0) / 2.0 - 0.55)) * 0.30"
        out += f", b{k} AS (SELECT list_append(seq, idx) AS seq, total + ({gain}) AS total, v AS last FROM p, b{k - 1} WHERE NOT list_contains(seq, idx) ORDER BY 2 DESC, 1 LIMIT 4)"
    return out


@query("beam_sequence", f"{P()}{beam_steps()} SELECT seq, round(total, 6) AS total FROM b4")
def beam_sequence(spark, d):
    return selection.beam(pool(spark, d)).select("seq", *r6("total"))


def _viterbi_sql() -> str:
    def own(s):
        w, need, pen = selection.SLOT_FIT[s]
        fit = "(" + " + ".join(f"p.{c} * CAST({x} AS DOUBLE)" for c, x in w.items()) + ")"
        cond = " OR ".join("p." + x for x in need.split(" OR ")) if need != "true" else "true"
        return f"(CASE WHEN {cond} THEN {fit} ELSE greatest(0.0, {fit} - {pen}) END * 0.25 + p.score * 0.10)"

    out = f"{G}, p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS nv FROM g)), d0 AS (SELECT idx, pos, v, light, [idx] AS seq, {own(0)} AS total FROM p)"
    for s in range(1, 5):
        step = f"q.total + {own(s)} + list_inner_product(q.v, p.v) * CAST(0.5 AS DOUBLE) + (1.0 - list_inner_product(q.v, p.v)) * CAST(0.3 AS DOUBLE) + (1.0 - abs(q.pos - p.pos) / CAST(greatest(p.nv - 1, 1) AS DOUBLE)) * CAST(0.2 AS DOUBLE) + abs(p.light - q.light) * 0.05"
        out += f", d{s} AS (SELECT idx, pos, v, light, list_append(qs, idx) AS seq, total FROM (SELECT p.idx, p.pos, p.v, p.light, q.seq AS qs, {step} AS total, row_number() OVER (PARTITION BY p.idx ORDER BY {step} DESC, q.pos) AS r FROM p, d{s - 1} q WHERE p.idx <> q.idx) WHERE r = 1)"
    out += ", w AS (SELECT seq, total FROM d4 ORDER BY total DESC, pos LIMIT 1), sp AS (SELECT list(idx ORDER BY score DESC, idx) AS spare FROM g WHERE NOT list_contains((SELECT seq FROM w), idx))"
    again = "list_contains(seq[1:i - 1], seq[i])"
    return out + f" SELECT list_filter(list_transform(range(1, len(seq) + 1), lambda i: CASE WHEN {again} THEN spare[len(list_filter(range(1, i + 1), lambda j: list_contains(seq[1:j - 1], seq[j])))] ELSE seq[i] END), lambda x: x IS NOT NULL) AS seq, round(total, 6) AS total FROM w, sp"


@query("viterbi_sequence", _viterbi_sql())
def viterbi_sequence(spark, d):
    g = selection.cut(store.numbered(grading.graded(spark, d), "idx", to="pos"))
    return selection.without_repeats(selection.viterbi(g, 0.5, 0.3, 0.2, g.count()), g).select("seq", *r6("total"))


def _roles_sql() -> str:
    out = f"{P()}, s0 AS (SELECT *, score AS value FROM p ORDER BY score DESC, idx LIMIT 1)"
    for k, w in enumerate(list(selection.ROLES.values())[1:], 1):
        used = " AND ".join(f"p.idx <> (SELECT idx FROM s{j})" for j in range(k))
        value = f"{_role(w).replace('comp', 'p.comp').replace('human', 'p.human').replace('light', 'p.light')} * CAST(0.6 AS DOUBLE) + (1.0 - list_inner_product(l.v, p.v)) * CAST({w[3]} AS DOUBLE) + p.score * CAST(0.2 AS DOUBLE)"
        out += f", s{k} AS (SELECT p.*, {value} AS value FROM p, s{k - 1} l WHERE {used} ORDER BY value DESC, p.score DESC, p.idx LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS pos, '{n}' AS slot, idx, round(value, 6) AS value FROM s{k}" for k, n in enumerate(selection.ROLES))


@query("role_assign", _roles_sql())
def role_assign(spark, d):
    df = pool(spark, d)
    return selection.as_frame(df, selection.assign_roles(df), OUT).withColumn("value", F.round("value", 6))


def fitted(spark, d):
    """All graded rows with fit_<slot>, match and lum01."""
    df = pool(spark, d)
    wide = scoring.slot_fitness(df).groupBy("idx").pivot("slot", scoring.SLOTS).agg(F.first("fitness"))
    wide = wide.select(F.col("idx").alias("i"), *[F.col(s).alias(f"fit_{s}") for s in scoring.SLOTS])
    out = df.join(wide, df.idx == wide.i).withColumns({"match": scoring.brief_match(F.col("score"), F.col("log")), "lum01": F.col("lum") / 255})
    return selection.cut(out.drop("i"))


def _fit_sql() -> str:
    from loomwise.queries.grading import _SLOT_SQL

    words = " + ".join(f"contains(lower(log), '{w}')::INT" for w in scoring.MATCH_WORDS)
    fits = _SLOT_SQL.replace("FROM g, mm", "FROM p, mm").replace("SELECT path,", "SELECT idx,")
    return f"""{P()}, mm AS (SELECT avg(lum / 255) AS m FROM p), sf AS ({fits}),
w AS (SELECT idx AS i, {", ".join(f"max(fitness) FILTER (WHERE slot = '{s}') AS fit_{s}" for s in scoring.SLOTS)} FROM sf GROUP BY idx),
c AS (SELECT p.*, w.*, 0.6 * score + 0.25 * least(1.0, length(log) / 400.0) + 0.15 * least(1.0, ({words}) / 4.0) AS match, lum / 255 AS lum01 FROM p JOIN w ON i = idx)""".replace("c AS (SELECT *, least", "c AS (SELECT *, least").replace("\nc AS (SELECT p.*", "\nfc AS (SELECT p.*")


def _greedy_sql(limit: float = 0.20) -> str:
    out = _fit_sql()
    for k, s in enumerate(scoring.SLOTS):
        prev = [f"s{j}" for j in range(k)]
        ok = f"fc.fit_{s} >= 0.25" + "".join(f" AND fc.idx <> {x}.idx AND NOT ({x}.cluster_id >= 0 AND {x}.cluster_id = fc.cluster_id)" for x in prev)
        sims = [f"list_inner_product({x}.v, fc.v)" for x in prev]
        pairs = [f"list_inner_product({a}.v, {b}.v)" for i, a in enumerate(prev) for b in prev[i + 1 :]]
        worst = f"greatest({', '.join(sims + pairs + ['-2.0'])})" if sims else "NULL"
        lums = "[" + ", ".join([f"{x}.lum01" for x in prev] + ["fc.lum01"]) + "]"
        match = "(" + " + ".join([f"{x}.match" for x in prev] + ["fc.match"]) + f") / {k + 1}"
        std = f"sqrt(list_sum(list_transform({lums}, lambda x: pow(x - list_sum({lums}) / {k + 1}, 2))) / {k + 1})"
        value = f"0.40 * {match} + 0.40 * {'(1.0 - worst)' if sims else '0.5'} + 0.20 * least(greatest(1.0 - {std} * 3.0, 0.0), 1.0)"
        out += f", e{k} AS (SELECT fc.*, {worst} AS worst, {value.replace('worst', worst)} AS value FROM {', '.join(['fc', *prev])} WHERE {ok}), s{k} AS (SELECT * FROM e{k} ORDER BY (worst IS NULL OR worst <= {limit}) DESC, value DESC, idx LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS pos, '{n}' AS slot, idx, round(value, 6) AS value FROM s{k}" for k, n in enumerate(scoring.SLOTS))


@query("greedy_slots", _greedy_sql())
def greedy_slots(spark, d):
    df = fitted(spark, d)
    return selection.as_frame(df, selection.greedy_slots(df, scoring.SLOTS, [0.25] * 5, 0.20), OUT).withColumn("value", F.round("value", 6))


#: Sets that the SQL's beam keeps to find a first feasible set.
BEAM = 200


def _best_sql(limit: float = 0.25) -> str:
    """Pairs, triples and so on of all rows, cut by what a set that holds them can reach at most; a beam says what is reached."""
    even = lambda n: f"greatest(0.0, least(1.0, 1 - 3 * sqrt(greatest(0.0, q - s * s / {n}) / 5)))"
    reach = lambda n: f"(m + {5 - n} * (SELECT max(match) FROM r)) / 5 + 1 - greatest(worst, -0.25) + {even(n)}"
    cut = lambda n: f"{reach(n)} >= (SELECT b FROM low)"
    out = _fit_sql()
    mask = " + ".join(f"(fit_{s} >= 0.25)::INT * {1 << k}" for k, s in enumerate(scoring.SLOTS))
    out += f""", r AS MATERIALIZED (SELECT idx, v, match, lum01, cluster_id, {mask} AS mask FROM fc WHERE {mask} > 0),
b1 AS (SELECT [idx] AS ids, [v] AS vs, [cluster_id] AS cl, -2.0 AS worst, match AS m, lum01 AS s, lum01 * lum01 AS q FROM r WHERE mask = 31)"""
    for n in range(2, 6):
        out += f""", b{n} AS MATERIALIZED (SELECT * FROM (SELECT list_append(ids, y.idx) AS ids, list_append(vs, y.v) AS vs, list_append(cl, y.cluster_id) AS cl, greatest(worst, list_max(list_transform(vs, lambda x: list_inner_product(x, y.v)))) AS worst, m + y.match AS m, s + y.lum01 AS s, q + y.lum01 * y.lum01 AS q
  FROM b{n - 1} JOIN r y ON y.mask = 31 AND y.idx > ids[{n - 1}] AND NOT (y.cluster_id >= 0 AND list_contains(cl, y.cluster_id))) WHERE worst <= {limit} ORDER BY {reach(n)} DESC, ids LIMIT {BEAM})"""
    out += f""", low AS MATERIALIZED (SELECT coalesce(max(m / 5 + 1 - worst + {even(5)}), -9.0) - 1e-9 AS b FROM b5),
e AS MATERIALIZED (SELECT * FROM (SELECT x.idx AS a, y.idx AS b, list_inner_product(x.v, y.v) AS worst, x.match + y.match AS m, x.lum01 + y.lum01 AS s, x.lum01 * x.lum01 + y.lum01 * y.lum01 AS q, x.mask AS ak, y.mask AS bk, y.match AS bm, y.lum01 AS bl
  FROM r x JOIN r y ON x.idx < y.idx AND NOT (x.cluster_id >= 0 AND x.cluster_id = y.cluster_id)) WHERE worst <= {limit} AND {cut(2)}),
n2 AS (SELECT a AS i1, b AS i2, [ak, bk] AS masks, worst, m, s, q FROM e)"""
    for n in range(3, 6):
        ids = [f"i{j}" for j in range(1, n)]
        out += f""", n{n}_0 AS MATERIALIZED (SELECT * FROM (SELECT {", ".join(f"p.{i}" for i in ids)}, l.b AS i{n}, list_append(p.masks, l.bk) AS masks, greatest(p.worst, l.worst) AS worst, p.m + l.bm AS m, p.s + l.bl AS s, p.q + l.bl * l.bl AS q
  FROM n{n - 1} p JOIN e l ON l.a = p.i{n - 1}) WHERE {cut(n)})"""
        for j in range(1, n - 1):  # one member more that the new row must have an edge with
            out += f""", n{n}_{j} AS MATERIALIZED (SELECT * FROM (SELECT p.* EXCLUDE (worst), greatest(p.worst, f.worst) AS worst FROM n{n}_{j - 1} p JOIN e f ON f.a = p.i{j} AND f.b = p.i{n}) WHERE {cut(n)})"""
        out += f", n{n} AS (SELECT * FROM n{n}_{n - 2})"
    orders = "[" + ", ".join(str(list(p)) for p in permutations(range(1, 6))) + "]"
    fits = " AND ".join(f"masks[o[{j + 1}]] // {1 << j} % 2 = 1" for j in range(5))
    return f"""{out}, dealt AS (SELECT *, list_filter({orders}, lambda o: {fits}) AS os FROM n5),
won AS (SELECT list_transform(os[1], lambda p: [i1, i2, i3, i4, i5][p]) AS seq, (m / 5 + 1 - worst + {even(5)}) / 3 AS total FROM dealt WHERE len(os) > 0)
SELECT seq, round(total, 6) AS total FROM won ORDER BY round(won.total, 9) DESC, seq LIMIT 1"""


@query("nsga_sequence", _best_sql())
def nsga_sequence(spark, d):
    return assignment.best_assignment(fitted(spark, d), scoring.SLOTS, sim_limit=0.25).select("seq", *r6("total"))


PREDICATES = [None, "human > 0.45 AND faces > 0", "tech > 0.55 OR comp > 0.60", "light < 0.40 OR narr < 0.50", "overall_c > 0.50 AND faces = 0"]


def _lookahead_sql() -> str:
    out = f"{P(20)}, q AS (SELECT *, tech + human AS tension FROM p), l0 AS (SELECT idx AS start, [idx] AS seq, [score] AS sc, [tension] AS tn, v AS last, CAST([] AS DOUBLE[]) AS sims FROM q)"
    for k in range(1, 5):
        order = f"CASE WHEN {PREDICATES[k]} THEN 1 ELSE 0 END DESC, list_inner_product(last, v) DESC, idx"
        out += f", l{k} AS (SELECT start, list_append(seq, idx) AS seq, list_append(sc, score) AS sc, list_append(tn, tension) AS tn, v AS last, list_append(sims, c) AS sims FROM (SELECT l.start, l.seq, l.sc, l.tn, l.sims, q.idx, q.score, q.tension, q.v, list_inner_product(last, v) AS c, row_number() OVER (PARTITION BY start ORDER BY {order}) AS r FROM q, l{k - 1} l WHERE NOT list_contains(seq, idx)) WHERE r = 1)"
    std = "sqrt(list_sum(list_transform(sc, lambda x: pow(x - list_sum(sc) / 5, 2))) / 5)"
    return f"{out}, z AS (SELECT start, seq, 0.45 * (list_sum(sims) / 4) + 0.35 * (1.0 - {std} / greatest({std}, 0.35)) + 0.20 * (list_sum(tn) / 5) AS total FROM l4) SELECT start, seq, round(total, 6) AS total FROM z ORDER BY total DESC, start LIMIT 1"


@query("lookahead_sequence", _lookahead_sql())
def lookahead_sequence(spark, d):
    return selection.lookahead(pool(spark, d, 20).withColumn("tension", F.col("tech") + F.col("human")), PREDICATES).select("start", "seq", *r6("total"))


def _editorial_sql() -> str:
    out = f"{G}, n AS (SELECT greatest(CAST(floor(count(*) * 0.7) AS BIGINT), 15) AS k FROM g), p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS rn FROM g) WHERE rn <= (SELECT k FROM n))"
    for k, w in enumerate(selection.EDITORIAL):
        used = " AND ".join(f"idx <> (SELECT idx FROM s{j})" for j in range(k)) or "true"
        value = " + ".join(f"{c} * CAST({x} AS DOUBLE)" for c, x in w.items()) or "1.0 - least(" + ", ".join(f"list_inner_product(v, (SELECT v FROM s{j}))" for j in range(k)) + ")"
        out += f", s{k} AS (SELECT *, {value} AS value FROM p WHERE {used} ORDER BY value DESC, score DESC, idx LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS pos, '{n}' AS slot, idx, round(value, 6) AS value FROM s{k}" for k, n in enumerate(selection.EDITORIAL_NAMES))


@query("editorial_slots", _editorial_sql())
def editorial_slots(spark, d):
    df = grading.graded(spark, d)
    return selection.as_frame(df, selection.editorial(df), OUT).withColumn("value", F.round("value", 6))


@query(
    "locked_slots",
    f"""{G}, fr AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS r FROM g WHERE path NOT IN ('item_40', 'item_41') AND idx % 10 <> 0)
SELECT CAST(1 AS INTEGER) AS pos, 'item_40' AS path UNION ALL SELECT 3, 'item_41' UNION ALL SELECT CASE r WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 4 END, path FROM fr WHERE r <= 3""",
)
def locked_slots(spark, d):
    g = grading.graded(spark, d)
    locks = spark.createDataFrame([(1, "item_40"), (3, "item_41")], "pos int, path string")
    return selection.locked_slots(g.select("path", "score"), locks, g.where("idx % 10 = 0").select("path"))


@query("story_select")
def story_select(spark, d):
    return selection.story(grading.graded(spark, d))


@query("portfolio_topn")
def portfolio_topn(spark, d):
    return selection.portfolio(grading.graded(spark, d)).select("idx", *r6("value", "bound"))


@query("portfolio_baseline", f"{G} SELECT idx, personal, CASE grade WHEN 'Strong' THEN 2 WHEN 'Mid' THEN 1 ELSE 0 END AS level FROM g ORDER BY level DESC, personal DESC, idx LIMIT 5")
def portfolio_baseline(spark, d):
    from loomwise.functions.scalar import grade_level

    g = grading.graded(spark, d).withColumn("level", grade_level(F.col("grade")))
    return selection.portfolio_baseline(g).select("idx", "personal", "level")
