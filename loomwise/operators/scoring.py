"""Scoring and grading of items: discriminants, calibration, fusion and grades, all as column expressions.

Batch statistics come from an aggregate of one row that is joined back by
broadcast, never from a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwise.functions.scalar import clip, grade, hits
from loomwise.functions.vectors import dot

#: Genre weights of the five aspects (technical, composition, lighting, narrative, human).
GENRE_WEIGHTS = {
    "Street": [0.03, 0.30, 0.18, 0.44, 0.05],
    "Liminal": [0.03, 0.14, 0.42, 0.38, 0.00],
    "Architectural": [0.18, 0.44, 0.26, 0.12, 0.00],
    "FineArt": [0.04, 0.18, 0.42, 0.33, 0.03],
}
ASPECTS = ["tech", "comp", "light", "narr", "human"]
#: Words that speak for a slot, and weights of the aspects in it.
SLOTS = ["Opener", "Subject", "Contrast", "Detail", "Closer"]
SLOT_WORDS = {
    "Opener": ["wide", "establishing", "scale", "cityscape", "landscape", "architecture", "overview", "exterior", "skyline", "panoramic"],
    "Subject": ["subject", "face", "person", "portrait", "decisive", "emotion", "candid", "human", "figure", "expression"],
    "Contrast": ["contrast", "shadow", "highlight", "dramatic", "silhouette", "chiaroscuro", "dark", "bright", "high-key", "low-key", "tonal"],
    "Detail": ["texture", "pattern", "detail", "close", "macro", "surface", "grain", "material", "intimate", "abstract"],
    "Closer": ["vanishing", "perspective", "depth", "horizon", "receding", "resolution", "closure", "finality", "fade"],
}
SLOT_ASPECTS = {
    "Opener": {"comp": 0.40, "tech": 0.30, "light": 0.30},
    "Subject": {"human": 0.50, "narr": 0.35, "tech": 0.15},
    "Contrast": {"light": 0.60, "tech": 0.25, "comp": 0.15},
    "Detail": {"tech": 0.50, "comp": 0.30, "light": 0.20},
    "Closer": {"comp": 0.45, "light": 0.35, "narr": 0.20},
}
#: Words of a log that speak for a match with a brief.
MATCH_WORDS = ["composition", "lighting", "contrast", "narrative", "balance", "decisive", "layer", "shadow", "texture", "depth", "empty", "liminal", "geometry", "atmosphere", "original"]


def prompt_similarities(items: DataFrame, prompts: DataFrame) -> DataFrame:
    """Add ``sims``, the dot products with all prompts. The prompts are one row of fixed size."""
    return items.crossJoin(F.broadcast(prompts)).withColumn("sims", F.transform("ps", lambda p: dot(F.col("v"), p))).drop("ps")


def discriminants(df: DataFrame, positives: int = 14, negatives: int = 5) -> DataFrame:
    """Add overall (best positive less best negative similarity) and the raw aspects."""
    n = positives + negatives
    at = lambda k: F.get("sims", F.lit(k))
    best = F.array_max(F.slice("sims", 1, positives)) - F.array_max(F.slice("sims", positives + 1, negatives))
    return df.withColumns({"overall": best} | {f"{a}_raw": at(n + k) - at(n + 5 + k) for k, a in enumerate(ASPECTS)})


def with_batch(df: DataFrame, *stats: Column) -> DataFrame:
    """Join statistics of the whole batch, one row, to every row."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def stretched(x: Column, low: Column, high: Column, scale: float, base: float, top: float) -> Column:
    return clip((x - low) / F.greatest(high - low, F.lit(1e-4)) * scale + base, base, top)


def calibrate(df: DataFrame) -> DataFrame:
    """Stretch overall and aspects over the batch to [0.10, 0.95]; columns overall_c and the aspects' names."""
    cols = {"overall": "overall_c"} | {f"{a}_raw": a for a in ASPECTS}
    both = with_batch(df, *[f(c).alias(f"{c}_{f.__name__}") for c in cols for f in (F.min, F.max)])
    out = both.withColumns({to: stretched(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max"), 0.85, 0.10, 0.95) for c, to in cols.items()})
    return out.drop(*[f"{c}_{f}" for c in cols for f in ("min", "max")])


def genre(tech: Column, comp: Column, light: Column, narr: Column, human: Column) -> Column:
    return (
        F.when((human < 0.38) & (comp > 0.52), "Architectural")
        .when((human < 0.35) & ((light > 0.50) | (narr > 0.48)), "Liminal")
        .when((light > 0.50) & (narr > 0.45), "FineArt")
        .otherwise("Street")
    )


def draft_score(df: DataFrame) -> DataFrame:
    """Add genre, score from genre-weighted aspects, confidence and tier."""
    cols = [F.col(a) for a in ASPECTS]
    df = df.withColumn("genre", genre(*cols))
    pick = F.create_map(*[x for g, w in GENRE_WEIGHTS.items() for x in (F.lit(g), F.array(*map(F.lit, w)))])
    weighted = sum((F.get(F.element_at(pick, F.col("genre")), F.lit(k)) * c for k, c in enumerate(cols)), F.lit(0.0))
    score = clip(0.60 * weighted + 0.40 * F.col("overall_c"), 0.15, 0.85)
    return df.withColumn("score", score).withColumns({"confidence": F.least(F.lit(1.0), 2 * F.abs(F.col("score") - 0.5)), "grade": grade(F.col("score"))})


def reasoning(df: DataFrame) -> DataFrame:
    """Add reasoning: tier, bars of the aspects from best to weakest, then the best and the weakest."""
    entries = F.array(*[F.struct((-F.col(a)).alias("o"), F.lit(k).alias("k"), F.lit(a).alias("a"), F.col(a).alias("x")) for k, a in enumerate(ASPECTS)])
    ordered = F.array_sort(entries)
    bars = F.transform(ordered, lambda s: F.concat(s.a, F.lit(" "), F.repeat(F.lit("#"), (s.x * 10).cast("int"))))
    return df.withColumn("reasoning", F.concat_ws(" | ", F.lower("grade"), F.array_join(bars, " "), F.concat(F.lit("best "), ordered[0].a), F.concat(F.lit("weakest "), ordered[4].a)))


def _quality_stats(col: str) -> list[Column]:
    return [F.min(col).alias("_q_lo"), F.max(col).alias("_q_hi"), F.count(col).alias("_q_n")]


def _quality_of(col: str) -> Column:
    wide = stretched(F.col(col), F.col("_q_lo"), F.col("_q_hi"), 0.80, 0.20, 1.0)
    return F.when(F.col("_q_n") < 2, clip(F.col(col), 0.20, 1.0)).otherwise(wide)


def _rated_stats(col: str, rated: Column) -> list[Column]:
    seen = F.when(rated, F.col(col))
    return [F.min(seen).alias("_r_lo"), F.max(seen).alias("_r_hi")]


def _rated_of(col: str) -> Column:
    return clip((F.col(col) - F.col("_r_lo")) / F.greatest(F.col("_r_hi") - F.col("_r_lo"), F.lit(1e-6)), 0.0, 1.0)


def quality_norm(df: DataFrame, col: str, to: str) -> DataFrame:
    """Stretch a quality over the batch to [0.20, 1]; a batch of one row is only clipped."""
    return with_batch(df, *_quality_stats(col)).withColumn(to, _quality_of(col)).drop("_q_lo", "_q_hi", "_q_n")


def stretch_by_rated(df: DataFrame, col: str, rated: Column, to: str) -> DataFrame:
    """Stretch with the minimum and maximum of the rated rows, applied to all rows."""
    return with_batch(df, *_rated_stats(col, rated)).withColumn(to, _rated_of(col)).drop("_r_lo", "_r_hi")


def batch_stretch(df: DataFrame, quality: str, quality_to: str, col: str, rated: Column, to: str) -> DataFrame:
    """:func:`quality_norm` and :func:`stretch_by_rated` from one aggregate of the batch."""
    both = with_batch(df, *_quality_stats(quality), *_rated_stats(col, rated))
    return both.withColumns({quality_to: _quality_of(quality), to: _rated_of(col)}).drop("_q_lo", "_q_hi", "_q_n", "_r_lo", "_r_hi")


ARCHETYPES = ["geo", "night", "lay", "messy", "max"]


def archetype_weights(df: DataFrame, first: int = 30, temperature: float = 0.42) -> DataFrame:
    """Add w_geo .. w_max: softmax of the similarities to five archetypes; messy yields to max."""
    sim = {a: clip(F.get("sims", F.lit(first + k)), -1.0, 1.0) for k, a in enumerate(ARCHETYPES)}
    df = df.withColumns({f"s_{a}": s for a, s in sim.items()})
    df = df.withColumns({f"x_{a}": F.exp(F.col(f"s_{a}") / temperature) for a in ARCHETYPES})
    messy = F.when(F.col("s_max") > F.col("s_messy"), 0.0).otherwise(F.col("x_messy"))
    df = df.withColumn("x_messy", messy).withColumn("x_sum", sum((F.col(f"x_{a}") for a in ARCHETYPES), F.lit(0.0)))
    df = df.withColumns({f"w_{a}": F.col(f"x_{a}") / F.col("x_sum") for a in ARCHETYPES})
    return df.drop("x_sum", *[f"{p}_{a}" for a in ARCHETYPES for p in ("s", "x")])


def fuse(df: DataFrame) -> DataFrame:
    """Add fused: the blend of archetypes with its gates, floors and ceilings.

    Needs quality, fineart, lum (0 to 255), lum_std, comp, light, narr, human,
    the weights of :func:`archetype_weights` and the flags disqualified,
    over_shoulder, chiaroscuro, soft_person and has_person.
    """
    c_ = F.col
    q, fa, c, li, n, h = c_("quality"), c_("fineart"), c_("comp"), c_("light"), c_("narr"), c_("human")
    w = {a: c_(f"w_{a}") for a in ARCHETYPES}
    top = F.greatest(*w.values())
    is_top = {a: w[a] == top for a in ARCHETYPES}
    others = lambda a: F.greatest(*[w[b] for b in ARCHETYPES if b != a])

    over = 0.40 * q + 0.30 * h + 0.30 * n
    over = F.when((h >= 0.70) & (n >= 0.60), F.greatest(over, F.lit(0.65))).otherwise(over)
    empty = 0.40 * c + 0.30 * li + 0.30 * q

    above = sum(((w[a] > w["messy"]).cast("int") for a in ARCHETYPES if a != "messy"), F.lit(0))
    messy = (w["messy"] > 0.40) | ((above == 1) & (c < 0.35))
    night = (is_top["night"] & (w["night"] > others("night") + 0.05)) | ((w["night"] > 0.35) & (c_("lum") / 2.55 < 30))
    sterile = (is_top["geo"] | (w["geo"] > 0.45)) & (h < 0.30)
    n_eff = F.when(sterile, 0.5 * n).otherwise(n)
    blend = (
        w["geo"] * (0.40 * c + 0.30 * li + 0.30 * q)
        + w["night"] * (0.35 * h + 0.35 * F.greatest(c, F.lit(0.70)) + 0.20 * q + 0.075)
        + w["lay"] * (0.40 * q + 0.30 * h + 0.30 * n_eff)
        + w["messy"] * F.greatest(F.lit(0.0), 0.35 * q + 0.65 * q - 0.08)
        + w["max"] * (0.45 * h + 0.35 * n_eff + 0.20 * q)
    )
    df = df.withColumns({"_f": blend, "_night": night, "_max": is_top["max"], "_messy": messy})
    sharp, cap = q, F.lit(1.0)
    f = c_("_f")
    f = F.when(c_("_night") & (sharp >= 0.52), F.greatest(f, F.lit(0.62))).otherwise(f)
    cap = F.when(c_("_night") & (sharp < 0.52), 0.42).otherwise(cap)
    f = F.when(c_("_max") & (sharp >= 0.55) & (li >= 0.35), F.greatest(f, F.lit(0.64))).otherwise(f)
    weak = ~((sharp >= 0.55) & (li >= 0.35)) & ((sharp < 0.45) | (li < 0.25))
    cap = F.when(c_("_max") & weak, F.least(cap, F.lit(0.38))).otherwise(cap)
    dark = c_("chiaroscuro") | (((c_("lum") < 40) | (c_("lum_std") < 30)) & (q >= 0.556))
    df = df.withColumns({"_g": f, "_cap": cap})
    g = F.when(dark, 0.75 * c_("_g") + 0.25 * fa).otherwise(c_("_g"))
    g = F.when(c_("soft_person") & ~c_("chiaroscuro"), g - 0.15).otherwise(g)
    g = F.when((q >= 0.72) | (fa >= 0.75) | ((h >= 0.70) & (n >= 0.60)), F.greatest(g, F.lit(0.65))).otherwise(g)
    g = F.when(c_("_messy"), F.least(g, F.lit(0.49))).otherwise(g)
    g = F.when((w["geo"] > 0.50) & (h < 0.25), F.least(g, F.lit(0.52))).otherwise(g)
    g = F.least(g, c_("_cap"))
    out = F.when(c_("disqualified"), 0.0).when((h >= 0.65) & (c < 0.35) & c_("over_shoulder"), over).when(~c_("has_person"), empty).otherwise(g)
    return df.withColumn("fused", clip(out, 0.0, 1.0)).drop("_f", "_g", "_night", "_max", "_messy", "_cap")


def finalise(df: DataFrame, trained: bool = True) -> DataFrame:
    """Add final and final_grade: personal blend, soft-focus boost, NaN to 0.15, clip to [0.10, 1]."""
    f = 0.80 * F.col("fused") + 0.20 * F.col("personal") if trained else F.col("fused")
    df = df.withColumn("_b", f)
    boosted = F.when((F.col("fineart") > 0.68) & (F.col("_b") >= 0.42), clip(F.col("_b") + 0.15, 0.0, 1.0)).otherwise(F.col("_b"))
    final = clip(F.nanvl(F.coalesce(boosted, F.lit(0.15)), F.lit(0.15)), 0.10, 1.0)
    return df.withColumn("final", final).withColumn("final_grade", grade(F.col("final"))).drop("_b")


def person_boxes(boxes: Column, min_conf: float = 0.55, min_area: float = 0.005) -> Column:
    """Detections that count as persons; boxes are structs of conf, x, y, w and h as shares of the frame."""
    return F.filter(boxes, lambda b: (b.conf >= min_conf) & (b.w * b.h >= min_area))


def over_the_shoulder(boxes: Column) -> Column:
    """A large figure at the edge of the frame with others in the middle ground."""
    area = F.transform(boxes, lambda b: b.w * b.h)
    front = F.element_at(F.array_sort(F.transform(boxes, lambda b: F.struct((-(b.w * b.h)).alias("o"), b.y.alias("y")))), 1)
    fg = -front.o
    middle = F.aggregate(F.filter(boxes, lambda b: (b.w * b.h < fg) & (b.y >= 0.30) & (b.y <= 0.70) & (b.w * b.h >= 0.001)), F.lit(0.0), lambda s, b: s + b.w * b.h)
    edge = (fg > 0.12) | (front.y < 0.22) | (front.y > 0.78)
    return (F.size(area) >= 2) & edge & (fg > 0.03) & (fg < 0.25) & (middle > 0.05) & (middle < 0.45)


def obstructed(boxes: Column) -> Column:
    """The largest box fills over 0.30 of the frame and stands left or right of its middle."""
    front = F.element_at(F.array_sort(F.transform(boxes, lambda b: F.struct((-(b.w * b.h)).alias("o"), b.x.alias("x")))), 1)
    return F.coalesce((-front.o > 0.30) & ((front.x < 0.35) | (front.x > 0.65)), F.lit(False))


def route(has_person: Column, obstruction: Column, layered: Column) -> Column:
    return F.when(~has_person, 1).when(obstruction | layered, 2).otherwise(0)


def empty_route_quality(comp: Column, light: Column) -> Column:
    return F.sqrt(F.greatest(comp, F.lit(0.01)) * F.greatest(light, F.lit(0.01)))


def chiaroscuro(lum: Column, std: Column, patch_var: Column | None = None) -> Column:
    deep = (lum < 35) & (std > 35)
    return deep if patch_var is None else deep | ((lum < 45) & (std >= 28) & (patch_var > 0.15))


def slot_fitness(df: DataFrame) -> DataFrame:
    """A row for each item and slot: fitness from log words, aspects and brightness (lum from 0 to 255)."""
    log = F.lower(F.coalesce("log", F.lit("")))
    lum = F.col("lum") / 255
    mean = F.broadcast(df.agg(F.avg(lum).alias("_m"), F.count("*").alias("_n")))
    parts = []
    for pos, s in enumerate(SLOTS):
        words = F.least(F.lit(1.0), hits(log, SLOT_WORDS[s]) / F.greatest(F.lit(2.0), F.lit(len(SLOT_WORDS[s]) * 0.3)))
        asp = sum((F.coalesce(F.col(a), F.lit(0.5)) * w for a, w in SLOT_ASPECTS[s].items()), F.lit(0.0))
        if s == "Contrast":
            f = 0.30 * words + 0.30 * asp + 0.40 * F.when(F.col("_n") > 1, clip(F.abs(lum - F.col("_m")) * 3.0, 0.0, 1.0)).otherwise(0.0)
        elif s == "Opener":
            f = 0.30 * words + 0.55 * asp + 0.15 * clip(lum * 1.5, 0.0, 1.0)
        else:
            f = 0.35 * words + 0.65 * asp
        parts.append(F.struct(F.lit(pos).alias("slot_pos"), F.lit(s).alias("slot"), f.alias("fitness")))
    each = df.crossJoin(mean).withColumn("_s", F.explode(F.array(*parts)))
    return each.select(*df.columns, "_s.slot_pos", "_s.slot", "_s.fitness")


def brief_match(score: Column, log: Column) -> Column:
    """The score, or with a log its blend with the log's length and matching words."""
    low = F.lower(log)
    full = 0.6 * score + 0.25 * F.least(F.lit(1.0), F.length(log) / 400.0) + 0.15 * F.least(F.lit(1.0), hits(low, MATCH_WORDS) / 4.0)
    return F.when(F.coalesce(log, F.lit("")) == "", score).otherwise(full)


#: Words of a brief that raise an aspect's weight.
BRIEF_WORDS = {
    "light": (2.8, ["rain", "wet", "reflection", "reflections", "puddle", "fog", "mist", "neon", "golden", "sunset", "sunrise", "shadow", "shadows", "glow", "night", "dusk", "dawn", "light", "dark", "atmosphere", "overcast", "cloudy", "mood", "moody", "hazy", "blue hour", "twilight"]),
    "narr": (2.8, ["moment", "emotion", "candid", "story", "decisive", "gesture", "expression", "drama", "tension", "solitude", "quiet", "fleeting", "encounter", "life"]),
    "human": (2.5, ["people", "crowd", "figure", "figures", "faces", "human", "pedestrian", "passerby", "culture", "community", "portrait", "stranger", "strangers"]),
    "comp": (2.8, ["geometry", "geometric", "architecture", "architectural", "pattern", "lines", "symmetry", "abstract", "structure", "grid", "form", "minimal", "minimalist"]),
}


def brief_weights(brief: str, no_people: bool = False, geometric: bool = False) -> dict[str, float]:
    """Aspect weights for a brief; a few strings, so plain Python."""
    low = brief.lower()
    w = {"narr": 1.0, "comp": 1.0, "light": 1.0, "tech": 0.5, "human": 1.0}
    for a, (value, words) in BRIEF_WORDS.items():
        if any(x in low for x in words) or (a == "comp" and geometric):
            w[a] = value
    if no_people:
        w["human"] = 0.0
    return w


def brief_score(score: Column, weights: dict[str, float]) -> Column:
    total = sum(weights.values()) or 1.0
    aligned = sum((F.coalesce(F.col(a), F.lit(0.5)) * w for a, w in weights.items()), F.lit(0.0)) / total
    return clip(0.60 * score + 0.40 * aligned, 0.0, 1.0)


def intrusion_penalty(score: Column, people_sim: Column, human: Column, factor: float = 0.10) -> Column:
    """A tenth of the score if people show where a brief wants none."""
    return F.when((people_sim > 0.40) | (human > 0.55), score * factor).otherwise(score)


def aesthetic_rescale(raw: Column) -> Column:
    return F.coalesce(clip((raw - 4.0) / 3.5, 0.0, 1.0), F.lit(0.5))


def semantic_alignment(sims: Column, positives: int = 8, negatives: int = 3) -> Column:
    mean = lambda start, n: F.aggregate(F.slice(sims, start, n), F.lit(0.0), lambda s, x: s + x) / n
    return clip((mean(1, positives) - mean(positives + 1, negatives) + 1) / 2, 0.0, 1.0)


def preference_loss(winner: Column, loser: Column, beta: float = 0.1) -> Column:
    """-log sigmoid of the scaled margin of two log-probability differences."""
    return F.log1p(F.exp(-beta * (winner - loser)))


def personal_floor(least: float) -> Column:
    """Whether a row passes a floor of its personal score; none for a floor of 0."""
    return F.lit(True) if least <= 0 else F.col("personal") >= least


def skip_by_confidence(confidence: Column, threshold: float = 0.88) -> Column:
    return confidence > threshold


def gate_priority(confidence: Column, threshold: float = 0.88) -> Column:
    return F.when(confidence > threshold, 1.0).otherwise(confidence / threshold)


def gate_for_memory(available: Column, total: Column, low: float = 0.70, high: float = 0.95, base: float = 0.88) -> Column:
    return F.when(total == 0, base).otherwise(high - (high - low) * available / total)


def gate_for_complexity(complexity: Column, base: float = 0.88, low: float = 0.70, high: float = 0.95) -> Column:
    return clip(base - 0.1 * complexity, low, high)


def deep_review(score: Column) -> Column:
    return (score > 0.65) | ((score >= 0.45) & (score <= 0.55))


def technical_score(sharpness: Column, exposure: Column, noise: Column, midtone: Column) -> Column:
    return clip(0.30 * sharpness + 0.28 * exposure + 0.22 * (1 - noise) + 0.20 * midtone, 0.0, 1.0)


def pixel_technical() -> Column:
    """Technical score of pixel statistics: sharpness less what exposure, noise and a want of midtones take away.

    Columns: sharp (the best focus measure), blur_cv, noise (mean of the shadows), blown
    and blocked (shares of pixels), midtones (share) and chiaroscuro. Soft focus with
    grain and an even blur counts as meant.
    """
    c = F.col
    sharp = F.least(c("sharp") / 400.0, F.lit(1.0))
    meant = (c("sharp") < 250) & (c("blur_cv") < 0.55) & (c("noise") > 1.5) & (c("sharp") > 8)
    sharp = F.when(c("sharp") >= 60, sharp).when(meant, F.greatest(sharp, F.lit(0.38))).otherwise(F.least(sharp, F.lit(0.18)))
    clipped = F.least(F.least(c("blown") * 4.0, F.lit(0.60)) + F.least(c("blocked") * 3.0, F.lit(0.40)), F.lit(0.70))
    exposure = F.when(c("chiaroscuro"), F.least(c("blown") * 2.0, F.lit(0.15))).otherwise(clipped)
    noise = F.least(c("noise") / 12.0, F.lit(0.50))
    return clip(sharp * (1.0 - exposure * 0.55) * (1.0 - noise * 0.35) * (0.80 + 0.20 * F.least(c("midtones") / 0.65, F.lit(1.0))), 0.0, 1.0)


def pixel_lighting() -> Column:
    """Lighting score of pixel statistics: mean, centre, std, local_std, mood and chiaroscuro; bands of brightness end at 40 and 210."""
    c = F.col
    dark, bright = c("mean") / 40.0 * 0.45, F.greatest(F.lit(0.0), (255 - c("mean")) / 45.0) * 0.45
    exposure = (
        F.when(c("chiaroscuro"), clip(1.0 - F.abs(c("centre") - 110) / 120.0, 0.0, 1.0))
        .when(c("mean") < 40, dark)
        .when(c("mean") > 210, bright)
        .otherwise(1.0 - F.abs(c("mean") - 118) / 170.0)
    )
    contrast, local = F.least(c("std") / 52.0, F.lit(1.0)), F.least(F.coalesce(c("local_std") / 38.0, F.lit(0.4)), F.lit(1.0))
    return clip(0.30 * exposure + 0.28 * contrast + 0.22 * local + 0.20 * clip(c("mood"), 0.0, 1.0), 0.0, 1.0)


def people_gate(boxes: Column, lum: Column, std: Column, min_conf: float = 0.35, min_area: float = 0.0008) -> Column:
    """hard, soft or pass for a brief without people; boxes have conf, w, h and lum."""
    seen = F.exists(F.coalesce(boxes, F.array().cast(_BOXES)), lambda b: (b.conf >= min_conf) & (b.w * b.h >= min_area) & (b.lum >= 15))
    return F.when(seen, "hard").when((lum < 35) & (std < 25), "soft").otherwise("pass")


_BOXES = "array<struct<conf:double,x:double,y:double,w:double,h:double,lum:double>>"


def sharp_enough(variance: Column, least: float = 4.0) -> Column:
    """Rows whose edge variance passes the blur gate; an unreadable image counts as sharp."""
    return F.coalesce(variance, F.lit(999.0)) >= least


def contains_grade(grade_text: Column, term: str) -> Column:
    return F.lit(term == "All") | F.contains(grade_text, F.lit(term))

