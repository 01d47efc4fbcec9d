"""What a gallery shows: row projections, filters, orders, counts and enrichments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwise.functions.scalar import file_name, folder, grade_level
from loomwise.functions.vectors import fit
from loomwise.operators.quantiles import exact_quantiles

GRADE_ORDER = {"Strong": 0, "Mid": 1, "Weak": 2}


def grade_order(grade: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(grade, F.lit(g)), k) for g, k in GRADE_ORDER.items()], F.lit(3))


def rows(df: DataFrame) -> DataFrame:
    """The gallery row: rounded scores, file name, and reject for duplicates that are not the best."""
    reject = (F.col("cluster_id") >= 0) & ~F.startswith("sim_flag", F.lit("Best"))
    return df.withColumns({"filename": file_name(F.col("path")), "score": F.round("score", 3), "reject": reject})


def projection(df: DataFrame, aspects: str) -> DataFrame:
    """All columns that a gallery shows, from :func:`rows` with v, personal, exif_ts and a map of further breakdown entries."""
    r3 = lambda c: F.round(F.col(c), 3)
    own = F.create_map(F.lit("Aesthetic"), r3("score"), F.lit("Personal"), r3("personal"))
    more = F.transform_values(F.coalesce(F.col(aspects), F.create_map().cast("map<string,double>")), lambda k, v: F.round(v, 3))
    # an entry of the aspects stands over one of the same name
    breakdown = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k)), more)
    return df.select(
        F.col("path").alias("id"), "path", "filename", "grade", r3("score").alias("score"), r3("score").alias("overall_score"), r3("score").alias("rating"),
        r3("personal").alias("human_perception"), r3("personal").alias("personal_score"), F.col("v").alias("embedding"), breakdown.alias("breakdown"),
        F.lit("").alias("critique"), F.lit("").alias("reasoning_log"), F.lit(False).alias("is_verified"), F.coalesce("exif_ts", F.lit(0.0)).alias("exif_ts"),
        F.coalesce("stars", F.lit(0)).alias("stars"), "reject", "sim_flag", "cluster_id",
    )


def unified(stored: DataFrame, cache: DataFrame, dims: int = 1152) -> DataFrame:
    """One row for each stored path, field by field from the cache, then the stored row, then a default; origin says which.

    stored has path, embedding, score, grade, quality, personal_score and exif_ts; cache
    has path, score, grade, critique and faces. Empty grades and personal scores of 0
    count as absent. Vectors of any length are filled up or cut to ``dims``; level is
    the grade's. Rows without a path are left out; of a path that the cache has more
    than once the greatest row stands.
    """
    rest = [c for c in ("grade", "score", "critique", "faces")]
    c = cache.groupBy("path").agg(F.max(F.struct(*rest)).alias("_c")).select(F.col("path").alias("_path"), *[F.col(f"_c.{x}").alias(f"_{x}") for x in rest])
    both = stored.where("path IS NOT NULL").join(c, F.col("path") == F.col("_path"), "left")
    some = lambda x, empty: F.when(x != empty, x)
    choice = {
        "grade": [("cache", some(F.col("_grade"), "")), ("stored", some(F.col("grade"), "")), ("default", F.lit(""))],
        "score": [("cache", F.col("_score").cast("double")), ("stored", F.col("score").cast("double")), ("default", F.lit(0.0))],
        "critique": [("cache", F.col("_critique")), ("default", F.lit(""))],
        "faces": [("cache", F.col("_faces")), ("default", F.lit(0))],
        "exif_ts": [("stored", F.col("exif_ts").cast("double")), ("default", F.lit(0.0))],
        "personal_score": [("stored", F.coalesce(some(F.col("quality").cast("double"), 0), some(F.col("personal_score").cast("double"), 0))), ("default", F.lit(0.5))],
    }
    value = {n: F.coalesce(*[v for _, v in of]).alias(n) for n, of in choice.items()}
    origin = F.struct(*[F.coalesce(*[F.when(v.isNotNull(), F.lit(who)) for who, v in of]).alias(n) for n, of in choice.items()]).alias("origin")
    vector = fit(F.col("embedding").cast("array<double>"), dims).alias("vector")
    return both.select("path", vector, *value.values(), origin).withColumn("level", grade_level(F.col("grade")))


def visible(df: DataFrame, grades: list[str] | None = None, min_stars: int = 0, hide_duplicates: bool = True) -> DataFrame:
    """Rows a gallery shows: members of a sequence always, if no grade is asked for."""
    ok = F.lit(True)
    if hide_duplicates:
        ok = ok & ~F.col("reject")
    if grades:
        ok = ok & F.col("grade").isin(grades)
    ok = ok & (F.coalesce("stars", F.lit(0)) >= min_stars)
    return df.where(ok if grades else ok | F.col("in_sequence"))


def grade_counts(df: DataFrame) -> DataFrame:
    is_ = lambda g: F.count_if(F.contains("grade", F.lit(g)))
    return df.agg(is_("Strong").alias("strong"), is_("Mid").alias("mid"), is_("Weak").alias("weak"), F.count("*").alias("total"))


def star_histogram(df: DataFrame) -> DataFrame:
    """stars 0 to 5 and their counts; null counts as 0."""
    found = df.groupBy(F.coalesce("stars", F.lit(0)).cast("int").alias("stars")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(6).select(F.col("id").cast("int").alias("stars"))
    return every.join(F.broadcast(found), "stars", "left").select("stars", F.coalesce("n", F.lit(0)).alias("n"))


def score_statistics(df: DataFrame, col: str = "score") -> DataFrame:
    """Figures of a score column in one row; the median comes from ranges, as one state of all values would not be bounded."""
    c = F.col(col)
    part = lambda cond: F.avg(cond.cast("int"))
    median = exact_quantiles(df, col, [0.5]).select(F.col("value").alias("median"))
    one = df.agg(
        F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
        part(F.col("faces") > 0).alias("with_faces"), part(c > 0.65).alias("strong_frac"), part(c < 0.45).alias("weak_frac"),
    )
    return one.join(F.broadcast(median), F.lit(True), "left")


def parents(df: DataFrame) -> DataFrame:
    """Distinct parent folders with the place of their first row, in that order; df has pos."""
    return df.groupBy(folder(F.col("path")).alias("folder")).agg(F.min("pos").alias("first")).orderBy("first")


def enrich(df: DataFrame, info: DataFrame, key: str = "path") -> DataFrame:
    """Left join by key; columns that both have are taken from df first, then from info."""
    other = info.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in info.columns if c != key])
    joined = df.join(other, df[key] == F.col("_k"), "left")
    mine = [F.coalesce(df[c], F.col(f"_{c}")).alias(c) if c != key and c in info.columns else df[c] for c in df.columns]
    return joined.select(*mine, *[F.col(f"_{c}").alias(c) for c in info.columns if c not in df.columns])


def restored(cached: DataFrame, new: DataFrame, order: DataFrame) -> DataFrame:
    """Cached and new rows by path, the new ones first choice, in the order (path, pos) of a folder."""
    cols = [c for c in cached.columns if c != "path"]
    c = cached.select("path", F.struct(*cols).alias("_c"))
    n = new.select("path", F.struct(*cols).alias("_n"))
    return c.join(n, "path", "full_outer").select("path", F.coalesce("_n", "_c").alias("r")).join(order, "path").select("pos", "path", "r.*").orderBy("pos")


def argmax_dimension(df: DataFrame, dims: list[str]) -> DataFrame:
    """strongest and weakest of one row of means; ties to the dimension listed first."""
    hi = F.array_max(F.array(*[F.struct(F.col(d).alias("x"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(dims)]))
    lo = F.array_min(F.array(*[F.struct(F.col(d).alias("x"), F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(dims)]))
    return df.select(hi["d"].alias("strongest"), lo["d"].alias("weakest"))


def aspect_bars(breakdown: Column, known: list[str], meta: list[str]) -> Column:
    """Entries of a map by value before it is rounded, largest first: known keys with default 0, meta keys left out."""
    full = F.map_zip_with(F.map_from_arrays(F.array(*map(F.lit, known)), F.array_repeat(F.lit(0.0), len(known))), breakdown, lambda k, a, b: F.coalesce(b, a))
    shown = F.map_filter(full, lambda k, v: ~k.isin(meta))
    ordered = F.array_sort(F.transform(F.map_entries(shown), lambda e: F.struct((-e.value).alias("o"), e.key.alias("k"))))
    return F.transform(ordered, lambda e: F.concat_ws("=", e.k, F.format_string("%.3f", F.bround(-e.o, 3))))


def feedback(df: DataFrame) -> DataFrame:
    """Upgrades, downgrades and a note once there are five changes and one kind outweighs the other 1.5 times."""
    up, down = F.count_if(F.col("new_level") > F.col("old_level")), F.count_if(F.col("new_level") < F.col("old_level"))
    one = df.agg(up.alias("upgrades"), down.alias("downgrades"), F.count("*").alias("total"))
    note = F.when(F.col("total") < 5, "none").when(F.col("upgrades") > 1.5 * F.col("downgrades"), "grades too low").when(F.col("downgrades") > 1.5 * F.col("upgrades"), "grades too high").otherwise("none")
    return one.withColumn("note", note)


def feedback_pairs(df: DataFrame) -> DataFrame:
    """winner and loser score of each changed grade: .72, .50 and .28 by grade, swapped on a downgrade."""
    value = lambda c: F.when(F.col(c) == 2, 0.72).when(F.col(c) == 1, 0.50).otherwise(0.28)
    changed = df.where("new_level <> old_level")
    return changed.select("path", F.greatest(value("new_level"), value("old_level")).alias("winner"), F.least(value("new_level"), value("old_level")).alias("loser"), (F.col("new_level") > F.col("old_level")).alias("upgrade"))
