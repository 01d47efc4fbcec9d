"""Niches and presets: rule lists, seed scores, preset scores with critique, and the recommender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwise.functions.scalar import clip

#: Fixed values: (niche, weights of c t h l a 1, gate), with c composition, t technical, h human, l lighting, a authenticity.
SEEDS = [
    ("Portrait/People", "h*0.48 + t*0.30 + l*0.22", "h > 0.48 AND t > 0.38 AND t >= a - 0.12"),
    ("Street/Urban", "a*0.46 + h*0.30 + c*0.24", "a > 0.36 AND h > 0.25 AND a >= t - 0.08"),
    ("Travel/Tourism", "h*0.34 + a*0.34 + l*0.32", "h > 0.32 AND a > 0.36 AND l > 0.33"),
    ("Architecture", "c*0.56 + t*0.26 + l*0.18", "c > 0.55 AND h < 0.28 AND c >= l"),
    ("Real Estate", "c*0.38 + l*0.44 + t*0.18", "c > 0.48 AND l > 0.48 AND h < 0.22"),
    ("Food/Culinary", "t*0.38 + l*0.40 + c*0.22", "t > 0.50 AND l > 0.48 AND h < 0.22"),
    ("Product/Commercial", "t*0.52 + c*0.34 + l*0.14", "t > 0.70 AND c > 0.58 AND h < 0.18"),
    ("Night/Nocturnal", "a*0.52 + c*0.28 + (1.0 - l)*0.20", "l < 0.38 AND a > 0.46"),
    ("Landscape/Nature", "l*0.56 + c*0.26 + a*0.18", "l > 0.38 AND h < 0.28 AND l >= c"),
    ("Wedding/Event", "h*0.48 + l*0.28 + c*0.24", "h > 0.58 AND l > 0.35"),
    ("Sports/Action", "t*0.50 + a*0.28 + h*0.22", "t > 0.62 AND h > 0.36"),
    ("Macro/Detail", "c*0.46 + t*0.42 + (1.0 - h)*0.12", "c > 0.60 AND t > 0.56 AND h < 0.18"),
    ("General/Mixed", "0.28", "true"),
]


def seed_sql(_: str) -> str:
    """The seed scores as a DuckDB list of structs (n, s) over columns c, t, h, l and a."""
    return "[" + ", ".join(f"struct_pack(n := '{n}', s := CAST(CASE WHEN {gate} THEN {f} ELSE 0.0 END AS DOUBLE))" for n, f, gate in SEEDS) + "]"


def seed_niche(df: DataFrame) -> DataFrame:
    """Add niche and seed: the best seed score, ties to the niche listed first. Needs comp, tech, human, light, auth."""
    short = {"c": "comp", "t": "tech", "h": "human", "l": "light", "a": "auth"}
    named = df.withColumns({k: F.col(v) for k, v in short.items()})
    named = named.withColumns({f"_s{k}": F.expr(f"CAST(CASE WHEN {gate} THEN {f} ELSE 0.0 END AS DOUBLE)") for k, (_, f, gate) in enumerate(SEEDS)})
    named = named.withColumn("seed", F.greatest(*[f"_s{k}" for k in range(len(SEEDS))]))
    first = F.coalesce(*[F.when(F.col(f"_s{k}") == F.col("seed"), n) for k, (n, _, _) in enumerate(SEEDS)])
    return named.select(*df.columns, first.alias("niche"), "seed")


#: Niche by the first condition that holds, over h c l t m (mood) and the signals of the image.
RULES = [
    ("n_faces >= 3 AND h > 0.60 AND l > 0.45", "Wedding/Event"),
    ("n_faces >= 1 AND h > 0.55", "Portrait/People"),
    ("h > 0.75 AND l > 0.50", "Wedding/Event"),
    ("h > 0.70", "Portrait/People"),
    ("c > 0.65 AND h < 0.35 AND (high_key OR backlit OR chiaroscuro OR m > 0.65 OR l > 0.65)", "Fine Art"),
    ("backlit AND n_faces = 0 AND c > 0.48", "Silhouette"),
    ("high_key AND c > 0.50", "High Key"),
    ("shadow_dark > 0.35 AND bright_frac < 0.25 AND center_mean < 80", "Night/Nocturnal"),
    ("l < 0.35 AND m > 0.60", "Night/Nocturnal"),
    ("directional_blur AND n_faces >= 1 AND decisive > 0.55", "Sports/Action"),
    ("directional_blur AND c > 0.52", "Motion/Long Exposure"),
    ("t > 0.80 AND c > 0.65 AND h < 0.25 AND best_sharp > 200", "Macro/Detail"),
    ("t > 0.85 AND c > 0.70 AND h < 0.20", "Product/Commercial"),
    ("c > 0.70 AND h < 0.20 AND n_faces = 0 AND m < 0.50", "Minimalist/Urbex"),
    ("c > 0.72 AND h < 0.25 AND n_faces = 0", "Architecture"),
    ("c > 0.75 AND h < 0.20", "Architecture"),
    ("l > 0.60 AND h < 0.30 AND n_faces = 0", "Landscape/Nature"),
    ("l > 0.65 AND h < 0.30", "Landscape/Nature"),
    ("m > 0.65 AND t > 0.50 AND h < 0.30 AND n_faces = 0", "Food/Culinary"),
    ("h > 0.50 AND m > 0.50", "Street/Urban"),
    ("h > 0.45 AND decisive > 0.50", "Street/Urban"),
    ("h > 0.40 AND c > 0.55", "Documentary/Travel"),
    ("h > 0.45", "Street/Urban"),
]
RULES_SQL = "CASE " + " ".join(f"WHEN {w} THEN '{n}'" for w, n in RULES) + " ELSE 'General/Mixed' END"


def niche_by_rules() -> Column:
    """Over columns h, c, l, t, m, n_faces and the signals named in the rules."""
    return F.expr(RULES_SQL)


def with_model(metric: Column, label: Column, confidence: Column, least: float = 0.85) -> Column:
    """A model's label stands only above a confidence, and if it differs."""
    return F.when((confidence > least) & (label != metric), label).otherwise(metric)


CRITERIA = ["decisive_moment", "layering_depth", "juxtaposition", "light_atmosphere", "authenticity", "composition_geometry"]
#: Weights of the criteria by preset.
PRESETS = {
    "Magnum Editor": [0.25, 0.20, 0.15, 0.15, 0.15, 0.10],
    "LSPF (London Street)": [0.30, 0.15, 0.20, 0.15, 0.10, 0.10],
    "SPI (International)": [0.20, 0.15, 0.30, 0.15, 0.10, 0.10],
}


def preset_score(df: DataFrame) -> DataFrame:
    """A row for each item and preset: score, grade and critique (a short code of the rule that spoke)."""
    parts = []
    for name, w in PRESETS.items():
        total = sum((F.col(c) * x for c, x in zip(CRITERIA, w, strict=True)), F.lit(0.0))
        score = clip(total + 0.2 * F.col("human_perception"), 0.0, 1.0)
        parts.append(F.struct(F.lit(name).alias("preset"), score.alias("preset_score")))
    each = df.withColumn("_p", F.explode(F.array(*parts))).select(*df.columns, "_p.preset", "_p.preset_score")
    s = F.col("preset_score")
    each = each.withColumn("preset_grade", F.when(s > 0.68, "Strong").when(s > 0.48, "Mid").otherwise("Weak"))
    return each.withColumn("critique", F.concat(critique(), human_note()))


CRITIQUE_SQL = """CASE
 WHEN preset_grade = 'Strong' THEN CASE
  WHEN preset LIKE 'LSPF%' THEN CASE WHEN decisive_moment > 0.70 THEN 'peak moment' WHEN authenticity > 0.65 THEN 'raw and well timed' ELSE 'cohesive' END
  WHEN preset LIKE 'SPI%' THEN CASE WHEN juxtaposition > 0.65 THEN 'sharp tension' WHEN decisive_moment > 0.65 THEN 'moment carries the tension' ELSE 'cohesive' END
  ELSE CASE WHEN decisive_moment > 0.70 THEN 'peak timing' WHEN layering_depth > 0.65 THEN 'layers tell the story' WHEN juxtaposition > 0.60 THEN 'strong irony' ELSE 'cohesive' END END
 WHEN preset_grade = 'Mid' THEN CASE
  WHEN preset LIKE 'LSPF%' THEN CASE WHEN decisive_moment < 0.45 THEN 'not the peak' WHEN authenticity < 0.40 THEN 'looks constructed' ELSE 'solid but plain' END
  WHEN preset LIKE 'SPI%' THEN CASE WHEN juxtaposition < 0.45 THEN 'lacks contradiction' WHEN light_atmosphere < 0.40 THEN 'flat light' ELSE 'solid but plain' END
  ELSE CASE WHEN authenticity < 0.40 THEN 'posed or processed' WHEN light_atmosphere < 0.40 THEN 'flat or harsh light' ELSE 'solid but plain' END END
 WHEN preset LIKE 'LSPF%' THEN 'no moment' WHEN preset LIKE 'SPI%' THEN 'no tension' ELSE 'static' END"""
NOTE_SQL = "CASE WHEN human_perception > 0.65 THEN '; harmonious' WHEN human_perception < 0.40 THEN '; unpolished' ELSE '' END"


def critique() -> Column:
    return F.expr(CRITIQUE_SQL)


def human_note() -> Column:
    return F.expr(NOTE_SQL)


#: Aspect labels of the five dimensions.
DIMENSIONS = {
    "tech": ["Technical", "News Sharpness", "Cleanliness", "Execution", "Detail Retention", "Exposure", "Sharpness & Detail"],
    "comp": ["Composition", "Framing", "Context", "Geometry & Balance", "Negative Space", "Framing Instinct", "Layered Depth"],
    "light": ["Lighting", "Atmosphere", "Natural Light", "Mood & Tone", "Tonal Purity", "Contrast Purity", "Available Light", "Natural Light Quality"],
    "auth": ["Decisive Moment", "Cultural Depth", "Journalistic Integrity", "Narrative Suggestion", "Conceptual Weight", "Reduction", "Authenticity", "Immediacy", "Environmental Truth"],
    "human": ["Subject Isolation", "Sense of Place", "Human Impact", "Character Presence", "Emotional Resonance", "Scale Element", "Human/Culture", "Presence", "Scale & Life"],
}


def dimension_means(df: DataFrame, default: float = 0.5) -> DataFrame:
    """One row with the mean of each dimension over all labels of the map ``breakdown``."""
    names = df.sparkSession.createDataFrame([(x, k) for k, v in DIMENSIONS.items() for x in v], "label string, dim string")
    long = df.select(F.explode("breakdown").alias("label", "value")).join(F.broadcast(names), "label")
    one = long.groupBy().agg(*[F.avg(F.when(F.col("dim") == k, F.col("value"))).alias(k) for k in DIMENSIONS])
    return one.select(*[F.coalesce(k, F.lit(default)).alias(k) for k in DIMENSIONS])


_C = "least(greatest({}, 0.0), 1.0)".format
#: Raw preset scores over the means t c l a h and batch statistics.
RECOMMEND = {
    "Snapshot / Point-and-Shoot": f"0.40 * {_C('greatest(' + _C('low_tech * 2.2') + ', ' + _C('score_std * 4.0') + ' * 0.8)')} * a + 0.25 * {_C('weak_frac * 1.5')} + 0.20 * {_C('with_faces')} + 0.15 * {_C('1.0 - strong_frac * 1.5')} - {_C('(t - 0.60) * 2.0')} * 0.35",
    "Classic Street": f"0.40 * {_C('least(' + _C('a - 0.30') + ', ' + _C('c - 0.30') + ', ' + _C('h - 0.30') + ') * 5.0')} + 0.25 * {_C('a')} + 0.20 * {_C('h')} + 0.15 * {_C('c')} - {_C('low_tech * 1.5')} * 0.20",
    "Photojournalism": f"0.40 * {_C('t * a * 2.0')} + 0.30 * {_C('(t - 0.50) * 3.0')} + 0.20 * {_C('h')} + 0.10 * {_C('a')} - {_C('(0.50 - t) * 3.0')} * 0.40",
    "Travel Editor": f"0.45 * {_C('h * a * 2.2')} + 0.25 * {_C('l')} + 0.20 * {_C('with_faces')} + 0.10 * {_C('c')} - {_C('no_people * 2.5')} * 0.35",
    "Humanist/Everyday": f"0.50 * {_C('greatest(0.0, h - 0.55) * 3.5')} + 0.25 * {_C('h * a * 2.0')} + 0.15 * {_C('with_faces')} + 0.10 * {_C('avg_faces / 2.0')} - {_C('no_people * 3.0')} * 0.50",
    "Cinematic/Editorial": f"0.45 * {_C('l * 1.4')} + 0.30 * {_C(_C('l - greatest(t, c, a, h) + 0.10') + ' * 3.0')} + 0.15 * {_C('c * l * 1.5')} + 0.10 * {_C('1.0 - abs(h - 0.45)')} - {_C('(0.55 - l) * 3.0')} * 0.40",
    "Landscape with Elements": f"0.40 * {_C('c * l * 2.0')} + 0.30 * {_C('no_people * 3.0')} + 0.20 * {_C('l * 1.3')} + 0.10 * {_C('c * 1.3')} - {_C('with_faces * 2.0')} * 0.40",
    "Minimalist/Urbex": f"0.45 * {_C('c * 1.4')} + 0.30 * {_C(_C('c - greatest(t, l, a, h) + 0.10') + ' * 3.5')} + 0.15 * {_C('no_people * 2.0')} + 0.10 * {_C('t')} - {_C('with_faces * 1.5')} * 0.30",
    "Fine Art/Contemporary": f"0.40 * {_C('c * 1.3')} + 0.25 * {_C('l')} + 0.20 * {_C('greatest(0.0, 0.50 - a) * 3.0')} + 0.15 * {_C('t')} - {_C('a - 0.65')} * 0.45",
    "LSPF (London Street)": f"0.35 * {_C('l * 1.2')} + 0.30 * {_C('h * a * 1.8')} + 0.20 * {_C('h')} + 0.15 * {_C('a')} - {_C('no_people * 2.0')} * 0.35",
}


def batch_statistics(df: DataFrame) -> DataFrame:
    """One row: means t c l a h and statistics of score and faces over the batch."""
    good = F.when(F.col("score") > 0, F.col("score"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.5))
    part = lambda cond: F.avg(cond.cast("int"))
    one = df.agg(
        mean("tech").alias("t"), mean("comp").alias("c"), mean("light").alias("l"), mean("narr").alias("a"), mean("human").alias("h"),
        F.coalesce(F.stddev_pop(good), F.lit(0.0)).alias("score_std"),
        F.avg("faces").alias("avg_faces"), part(F.col("faces") > 0).alias("with_faces"), part(F.col("score") > 0.65).alias("strong_frac"), part(F.col("score") < 0.45).alias("weak_frac"),
    )
    return one.withColumns({"low_tech": F.greatest(F.lit(0.0), 0.45 - F.col("t")), "no_people": F.greatest(F.lit(0.0), 0.30 - F.col("h"))})


def recommend(df: DataFrame) -> DataFrame:
    """preset, score (stretched to [0, 1]), rank and the confidence of the first, over a batch of graded items."""
    one = batch_statistics(df)
    each = F.array(*[F.struct(F.lit(n).alias("preset"), F.expr(f"CAST({f} AS DOUBLE)").alias("raw")) for n, f in RECOMMEND.items()])
    row = one.select(each.alias("p")).withColumns({"lo": F.array_min(F.transform("p", lambda x: x.raw)), "hi": F.array_max(F.transform("p", lambda x: x.raw))})
    scored = F.transform("p", lambda x: F.struct((-(x.raw - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(0.01))).alias("o"), x.preset.alias("preset")))
    ranked = row.select(F.array_sort(scored).alias("s"))
    gap = F.element_at("s", 2)["o"] - F.element_at("s", 1)["o"]
    conf = F.bround(F.least(gap * 2.5, F.lit(1.0)) * 99).cast("int")
    return ranked.select(conf.alias("confidence"), F.posexplode("s").alias("k", "x")).select((F.col("k") + 1).alias("rank"), "x.preset", (-F.col("x.o")).alias("score"), "confidence")


#: Profiles of tech, comp, light, auth and human.
PROFILES = {
    "Cinematic/Editorial": [0.3, 0.4, 0.9, 0.5, 0.5],
    "Travel Editor": [0.4, 0.4, 0.6, 0.9, 0.8],
    "Photojournalism": [0.8, 0.5, 0.5, 0.8, 0.7],
    "Fine Art/Contemporary": [0.5, 0.7, 0.6, 0.4, 0.9],
    "Minimalist/Urbex": [0.6, 0.9, 0.5, 0.3, 0.4],
    "Humanist/Everyday": [0.4, 0.5, 0.5, 0.7, 0.8],
    "Classic Street": [0.6, 0.7, 0.5, 0.7, 0.6],
}


def profile_match(df: DataFrame) -> DataFrame:
    """preset and similarity of the profile nearest to the batch's mean aspects; ties to the one listed first."""
    dims = ["tech", "comp", "light", "narr", "human"]
    one = df.agg(*[F.avg(c).alias(c) for c in dims])
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in dims), F.lit(0.0))) + 1e-6
    each = []
    for k, (name, w) in enumerate(PROFILES.items()):
        ideal = sum(x * x for x in w) ** 0.5 + 1e-6
        sim = sum((F.col(c) * x for c, x in zip(dims, w, strict=True)), F.lit(0.0)) / (length * ideal)
        each.append(F.struct(sim.alias("similarity"), F.lit(-k).alias("k"), F.lit(name).alias("preset")))
    return one.select(F.array_max(F.array(*each)).alias("b")).select("b.preset", "b.similarity")
