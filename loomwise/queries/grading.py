"""Queries over the grading plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwise.functions.scalar import clip, grade_level
from loomwise.operators import scoring
from loomwise.plans import grading, items

A = scoring.ASPECTS
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def s6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("grade_slice", f"{grading.SQL} SELECT path, genre, grade, {s6('overall_c', *A, 'score', 'confidence')} FROM g")
def grade_slice(spark, d):
    return grading.graded(spark, d).select("path", "genre", "grade", *r6("overall_c", *A, "score", "confidence"))


@query("genre_counts", f"{grading.SQL} SELECT genre, count(*) AS n, count(*) FILTER (WHERE grade = 'Strong') AS strong, count(*) FILTER (WHERE grade = 'Mid') AS mid, count(*) FILTER (WHERE grade = 'Weak') AS weak FROM g GROUP BY genre")
def genre_counts(spark, d):
    is_ = lambda x: F.count_if(F.col("grade") == x)
    return grading.graded(spark, d).groupBy("genre").agg(F.count("*").alias("n"), is_("Strong").alias("strong"), is_("Mid").alias("mid"), is_("Weak").alias("weak"))


@query("calibrated_aspects", f"{grading.SQL} SELECT path, {s6(*[a + '_raw' for a in A], *A)} FROM g")
def calibrated_aspects(spark, d):
    return grading.graded(spark, d).select("path", *r6(*[a + "_raw" for a in A], *A))


@query(
    "reasoning_text",
    f"""{grading.SQL},
e AS (SELECT path, grade, unnest([{", ".join(f"struct_pack(o := -{a}, k := {k}, a := '{a}', x := {a})" for k, a in enumerate(A))}]) AS s FROM g),
l AS (SELECT path, grade, list(s ORDER BY s) AS l FROM e GROUP BY path, grade)
SELECT path, concat_ws(' | ', lower(grade), array_to_string(list_transform(l, lambda s: s.a || ' ' || repeat('#', CAST(trunc(s.x * 10) AS INTEGER))), ' '), 'best ' || l[1].a, 'weakest ' || l[5].a) AS reasoning FROM l""",
)
def reasoning_text(spark, d):
    return scoring.reasoning(grading.graded(spark, d)).select("path", "reasoning")


@query("quality_norm", f"{grading.SQL_FUSED} SELECT path, {s6('q0', 'quality')} FROM f")
def quality_norm(spark, d):
    return grading.fused(spark, d).select("path", *r6("q0", "quality"))


@query("fineart_stretch", f"{grading.SQL_FUSED} SELECT path, {s6('fa0', 'fineart')}, disqualified FROM f")
def fineart_stretch(spark, d):
    return grading.fused(spark, d).select("path", *r6("fa0", "fineart"), "disqualified")


@query("archetype_blend", f"{grading.SQL_FUSED} SELECT path, {s6(*['w_' + a for a in scoring.ARCHETYPES])} FROM f")
def archetype_blend(spark, d):
    return grading.fused(spark, d).select("path", *r6(*[f"w_{a}" for a in scoring.ARCHETYPES]))


@query("score_fusion", f"{grading.SQL_FUSED} SELECT path, {s6('fused')} FROM f")
def score_fusion(spark, d):
    return grading.fused(spark, d).select("path", *r6("fused"))


@query("final_grade", f"{grading.SQL_FUSED} SELECT path, {s6('final')}, final_grade FROM f")
def final_grade(spark, d):
    return grading.fused(spark, d).select("path", *r6("final"), "final_grade")


_SLOT_SQL = " UNION ALL ".join(
    f"SELECT path, {k} AS slot_pos, '{s}' AS slot, "
    + {"Contrast": "0.30 * {w} + 0.30 * {a} + 0.40 * least(greatest(abs(lum / 255 - m) * 3.0, 0.0), 1.0)", "Opener": "0.30 * {w} + 0.55 * {a} + 0.15 * least(greatest(lum / 255 * 1.5, 0.0), 1.0)"}.get(s, "0.35 * {w} + 0.65 * {a}").format(
        w=f"least(1.0, ({' + '.join(f'contains(lower(log), {x!r})::INT' for x in scoring.SLOT_WORDS[s])}) / CAST(greatest(2.0, {len(scoring.SLOT_WORDS[s]) * 0.3}) AS DOUBLE))",
        a="(" + " + ".join(f"coalesce({a}, 0.5) * CAST({w} AS DOUBLE)" for a, w in scoring.SLOT_ASPECTS[s].items()) + ")",
    )
    + " AS fitness FROM g, mm"
    for k, s in enumerate(scoring.SLOTS)
)


@query("slot_fitness", f"{grading.SQL}, mm AS (SELECT avg(lum / 255) AS m FROM g), sf AS ({_SLOT_SQL}) SELECT path, slot_pos, slot, {s6('fitness')} FROM sf")
def slot_fitness(spark, d):
    return scoring.slot_fitness(grading.graded(spark, d)).select("path", "slot_pos", "slot", *r6("fitness"))


@query(
    "brief_match",
    f"""{grading.SQL} SELECT path, round(CASE WHEN log = '' THEN score ELSE 0.6 * score + 0.25 * least(1.0, length(log) / 400.0)
 + 0.15 * least(1.0, ({" + ".join(f"contains(lower(log), '{w}')::INT" for w in scoring.MATCH_WORDS)}) / 4.0) END, 6) AS objective FROM g""",
)
def brief_match(spark, d):
    return grading.graded(spark, d).select("path", F.round(scoring.brief_match(F.col("score"), F.col("log")), 6).alias("objective"))


BRIEF = "Quiet geometry in the rain, no people"
_WEIGHTS = scoring.brief_weights(BRIEF, no_people=True)


@query(
    "brief_rescoring",
    f"""{grading.SQL} SELECT path, round(least(greatest(0.60 * pen + 0.40 * ({" + ".join(f"{a} * CAST({w} AS DOUBLE)" for a, w in _WEIGHTS.items())}) / CAST({sum(_WEIGHTS.values())} AS DOUBLE), 0.0), 1.0), 6) AS aligned, round(pen, 6) AS penalised
FROM (SELECT *, CASE WHEN sims[36] > 0.40 OR human > 0.55 THEN score * 0.10 ELSE score END AS pen FROM g)""",
)
def brief_rescoring(spark, d):
    df = grading.graded(spark, d).withColumn("penalised", scoring.intrusion_penalty(F.col("score"), F.get("sims", F.lit(35)), F.col("human")))
    return df.select("path", F.round(scoring.brief_score(F.col("penalised"), _WEIGHTS), 6).alias("aligned"), *r6("penalised"))


@query(
    "confidence_gates",
    f"""{grading.SQL} SELECT path, confidence > 0.88 AS skip, round(CASE WHEN confidence > 0.88 THEN 1.0 ELSE confidence / 0.88 END, 6) AS priority,
 round(0.95 - (CAST(0.95 AS DOUBLE) - 0.70) * lum / 256, 6) AS by_memory, round(least(greatest(0.88 - 0.1 * comp, 0.70), 0.95), 6) AS by_complexity, score > 0.65 OR (score >= 0.45 AND score <= 0.55) AS deep FROM g""",
)
def confidence_gates(spark, d):
    g, c = grading.graded(spark, d), F.col("confidence")
    return g.select(
        "path",
        scoring.skip_by_confidence(c).alias("skip"),
        F.round(scoring.gate_priority(c), 6).alias("priority"),
        F.round(scoring.gate_for_memory(F.col("lum"), F.lit(256)), 6).alias("by_memory"),
        F.round(scoring.gate_for_complexity(F.col("comp")), 6).alias("by_complexity"),
        scoring.deep_review(F.col("score")).alias("deep"),
    )


#: Pixel statistics that stand for an item's.
_PIXELS = {
    "sharp": "CAST((idx * 17) % 500 AS DOUBLE)", "blur_cv": "CAST(idx % 10 AS DOUBLE) / 10", "noise": "CAST((idx * 7) % 80 AS DOUBLE) / 10", "blown": "CAST(idx % 13 AS DOUBLE) / 50",
    "blocked": "CAST(idx % 11 AS DOUBLE) / 40", "midtones": "CAST((idx * 3) % 100 AS DOUBLE) / 100", "mean": "lum", "centre": "CAST((idx * 29) % 256 AS DOUBLE)", "std": "lum_std",
    "local_std": "CASE WHEN idx % 9 > 0 THEN CAST(idx % 60 AS DOUBLE) END", "mood": "CAST((idx * 5) % 130 AS DOUBLE) / 100 - 0.1", "chiaroscuro": "lum < 35 AND lum_std > 35",
}


@query(
    "pixel_scores",
    f"""{grading.SQL}, px AS (SELECT path, {', '.join(f'{x} AS {n}' for n, x in _PIXELS.items())} FROM g),
py AS (SELECT *, CASE WHEN sharp >= 60 THEN least(sharp / 400.0, 1.0) WHEN sharp < 250 AND blur_cv < 0.55 AND noise > 1.5 AND sharp > 8 THEN greatest(sharp / 400.0, 0.38) ELSE least(sharp / 400.0, 0.18) END AS s,
 CASE WHEN chiaroscuro THEN least(blown * 2, 0.15) ELSE least(least(blown * 4, 0.60) + least(blocked * 3, 0.40), 0.70) END AS e,
 CASE WHEN chiaroscuro THEN least(greatest(1 - abs(centre - 110) / 120, 0), 1) WHEN mean < 40 THEN mean / 40 * 0.45 WHEN mean > 210 THEN greatest(0, (255 - mean) / 45) * 0.45 ELSE 1 - abs(mean - 118) / 170 END AS x FROM px)
SELECT path, round(least(greatest(s * (1 - e * 0.55) * (1 - least(noise / 12, 0.50) * 0.35) * (0.80 + 0.20 * least(midtones / 0.65, 1.0)), 0.0), 1.0), 6) AS technical,
 round(least(greatest(0.30 * x + 0.28 * least(std / 52, 1.0) + 0.22 * least(coalesce(local_std / 38, 0.4), 1.0) + 0.20 * least(greatest(mood, 0.0), 1.0), 0.0), 1.0), 6) AS lighting FROM py""",
)
def pixel_scores(spark, d):
    g = grading.graded(spark, d).selectExpr("path", *[f"{x} AS {n}" for n, x in _PIXELS.items()])
    return g.select("path", F.round(scoring.pixel_technical(), 6).alias("technical"), F.round(scoring.pixel_lighting(), 6).alias("lighting"))


@query(
    "feature_scores",
    f"""{grading.SQL} SELECT path, round(least(greatest((lum / 32 - 4.0) / 3.5, 0.0), 1.0), 6) AS aesthetic,
 round(least(greatest((list_sum(sims[1:8]) / 8 - list_sum(sims[9:11]) / 3 + 1) / 2, 0.0), 1.0), 6) AS alignment,
 round(ln(1 + exp(-0.1 * (score - overall_c))), 6) AS loss, round(least(greatest(0.30 * tech + 0.28 * light + 0.22 * (1 - narr) + 0.20 * comp, 0.0), 1.0), 6) AS technical,
 CASE WHEN NOT faces > 0 THEN 1 WHEN idx % 5 = 0 OR idx % 7 = 0 THEN 2 ELSE 0 END AS route FROM g""",
)
def feature_scores(spark, d):
    g = grading.graded(spark, d)
    return g.select(
        "path",
        F.round(scoring.aesthetic_rescale(F.col("lum") / 32), 6).alias("aesthetic"),
        F.round(scoring.semantic_alignment(F.col("sims")), 6).alias("alignment"),
        F.round(scoring.preference_loss(F.col("score"), F.col("overall_c")), 6).alias("loss"),
        F.round(scoring.technical_score(F.col("tech"), F.col("light"), F.col("narr"), F.col("comp")), 6).alias("technical"),
        scoring.route(F.col("faces") > 0, F.col("idx") % 5 == 0, F.col("idx") % 7 == 0).alias("route"),
    )


@query(
    "grade_levels",
    f"""{grading.SQL}, t AS (SELECT path, CASE idx % 5 WHEN 0 THEN grade WHEN 1 THEN CAST(idx % 10 AS VARCHAR) WHEN 2 THEN '0.' || (idx % 10) WHEN 3 THEN '' ELSE upper(grade) END AS text FROM g)
SELECT path, text, CASE WHEN contains(text, 'Strong') THEN 2 WHEN contains(text, 'Mid') THEN 1 WHEN contains(text, 'Weak') THEN 0 WHEN try_cast(text AS DOUBLE) >= 0.7 THEN 2 WHEN try_cast(text AS DOUBLE) >= 0.4 THEN 1 WHEN try_cast(text AS DOUBLE) IS NOT NULL THEN 0 ELSE 1 END AS level FROM t""",
)
def grade_levels(spark, d):
    i, g = F.col("idx") % 5, F.col("grade")
    text = F.when(i == 0, g).when(i == 1, (F.col("idx") % 10).cast("string")).when(i == 2, F.concat(F.lit("0."), F.col("idx") % 10)).when(i == 3, "").otherwise(F.upper(g))
    return grading.graded(spark, d).select("path", text.alias("text")).withColumn("level", grade_level(F.col("text")))


_BOXES = "[struct_pack(conf := 0.5 + (id % 6) / 10.0, x := (id % 10) / 10.0, y := (id % 9) / 9.0, w := 0.1 + (id % 7) / 10.0, h := 0.1 + (id % 5) / 10.0), struct_pack(conf := 0.9, x := 0.5, y := 0.5, w := 0.3, h := 0.2 + (id % 3) / 10.0)]"


@query(
    "box_rules",
    f"""WITH b AS (SELECT vec_id AS id, list_transform({_BOXES.replace("id %", "vec_id %")}, lambda x: struct_pack(conf := CAST(x.conf AS DOUBLE), x := CAST(x.x AS DOUBLE), y := CAST(x.y AS DOUBLE), w := CAST(x.w AS DOUBLE), h := CAST(x.h AS DOUBLE))) AS bs FROM embeddings),
m AS (SELECT id, bs, CASE WHEN bs[1].w * bs[1].h > bs[2].w * bs[2].h THEN bs[1] WHEN bs[1].w * bs[1].h = bs[2].w * bs[2].h THEN CASE WHEN bs[1].y <= bs[2].y THEN bs[1] ELSE bs[2] END ELSE bs[2] END AS fr FROM b),
k AS (SELECT *, fr.w * fr.h AS fg, coalesce(list_sum(list_transform(list_filter(bs, lambda x: x.w * x.h < fr.w * fr.h AND x.y >= 0.30 AND x.y <= 0.70 AND x.w * x.h >= 0.001), lambda x: x.w * x.h)), 0.0) AS mg FROM m)
SELECT id, len(list_filter(bs, lambda x: x.conf >= 0.55 AND x.w * x.h >= 0.005)) AS persons,
 (fg > 0.12 OR fr.y < 0.22 OR fr.y > 0.78) AND fg > 0.03 AND fg < 0.25 AND mg > 0.05 AND mg < 0.45 AS over_shoulder FROM k""",
)
def box_rules(spark, d):
    i = F.col("id")
    one = lambda c, x, y, w, h: F.struct(c.alias("conf"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    lit = lambda v: F.lit(v)
    boxes = F.array(one(0.5 + (i % 6) / 10, (i % 10) / 10, (i % 9) / 9, 0.1 + (i % 7) / 10, 0.1 + (i % 5) / 10), one(lit(0.9), lit(0.5), lit(0.5), lit(0.3), 0.2 + (i % 3) / 10))
    df = items.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), boxes.alias("bs"))
    return df.select("id", F.size(scoring.person_boxes(F.col("bs"))).cast("long").alias("persons"), scoring.over_the_shoulder(F.col("bs")).alias("over_shoulder"))


@query("score_clip_nan", "SELECT event_id, round(least(greatest(value / 100, 0.10), 1.0), 6) AS clipped FROM events")
def score_clip_nan(spark, d):
    return items.table(spark, d, "events").select("event_id", F.round(clip(F.nanvl(F.col("value") / 100, F.lit(0.15)), 0.10, 1.0), 6).alias("clipped"))
