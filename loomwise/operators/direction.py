"""The whole creative direction: from a brief and graded rows to copied files in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.functions.scalar import file_name, has_any
from loomwise.operators import constraints, scoring, selection, similarity
from loomwise.session import materialised
from loomwise.sources import export

#: The least share of a picture that a person's box has in a direction, and the aspects' weights without any word.
AREA = 0.0005
NEUTRAL = {"narr": 1.0, "comp": 1.0, "light": 1.0, "tech": 0.5, "human": 1.0}
#: Fixed value: what a copied file's name ends with.
SUFFIX = "_purist.jpg"


def settings(spark: SparkSession, brief: str, theme: str = "", colours: str = "") -> DataFrame:
    """One row: brief, its settings, whether it wants no people (hard) or speaks of emptiness (empty), and a weight w_ for each aspect."""
    one = spark.createDataFrame([(brief or "", theme, colours)], "brief string, theme string, colours string")
    rules = constraints.brief_settings({k: F.col(k) for k in ("brief", "theme", "colours")})
    one = one.select("brief", *[c.alias(n) for n, c in rules.items()])
    low, hard = F.lower("brief"), F.col("hard_filter") != "none"
    weights = []
    for aspect, neutral in NEUTRAL.items():
        w = F.lit(neutral)
        if aspect in scoring.BRIEF_WORDS:
            more, words = scoring.BRIEF_WORDS[aspect]
            named = has_any(low, words) | (F.lit(aspect == "comp") & (F.col("geometric_priority") == "High"))
            w = F.when(named, more).otherwise(neutral)
        weights.append((F.when(hard, 0.0).otherwise(w) if aspect == "human" else w).alias(f"w_{aspect}"))
    return one.select("*", hard.alias("hard"), has_any(low, constraints.EMPTY).alias("empty"), *weights)


def directed(df: DataFrame, rules: DataFrame, near: float = 0.92, frames: int = 7, avoid: DataFrame | None = None) -> DataFrame:
    """pos, idx, role and score of a story for a brief: gates, dedup, penalty, rescoring, selection and order.

    df is graded, with path, gate, sharp and the people similarity in sims; rules is the
    row of :func:`settings`. A brief without people drops rows of a hard gate; one of
    emptiness takes nine tenths from rows where people show. Paths to avoid are left
    out unless no others are there.
    """
    spark = df.sparkSession
    keep = F.col("sharp") & (~F.col("hard") | (F.col("gate") != "hard"))
    rows = materialised(df.crossJoin(F.broadcast(rules)).where(keep).withColumnRenamed("idx", "id"), "gated")
    rows = similarity.greedy_dedup(spark, rows, near).withColumnRenamed("id", "idx")
    score = F.when(F.col("empty"), scoring.intrusion_penalty(F.col("score"), F.get("sims", F.lit(35)), F.col("human"))).otherwise(F.col("score"))
    total = sum((F.col(f"w_{a}") for a in NEUTRAL), F.lit(0.0))
    aligned = sum((F.coalesce(F.col(a), F.lit(0.5)) * F.col(f"w_{a}") for a in NEUTRAL), F.lit(0.0)) / F.when(total > 0, total).otherwise(1.0)
    blended = F.least(F.greatest(0.60 * F.col("score") + 0.40 * aligned, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("score", score).withColumn("score", F.when(F.trim("brief") == "", F.col("score")).otherwise(blended))
    if avoid is not None:
        free = rows.join(avoid.select("path").distinct(), "path", "left_anti")
        rows = rows if free.isEmpty() else free
    return selection.story(rows, frames)


def finished(story: DataFrame, paths: DataFrame, rules: DataFrame, dest: str) -> DataFrame:
    """Copy a story's files (paths: idx, path) to ``dest`` and return pos, idx, role, score, source, target, outcome and log."""
    named = story.join(paths.select("idx", F.col("path").alias("source")), "idx").crossJoin(F.broadcast(rules.select("brief", "hard", "geometric_priority", "lighting")))
    name = F.concat(F.regexp_replace(file_name(F.col("source")), r"\.[^.]*$", ""), F.lit(SUFFIX))
    log = F.concat(
        F.lit("Role: "), F.upper("role"), F.lit(" - original capture.\nScore: "), F.format_string("%.3f", "score"), F.lit("  |  Brief: '"), F.substring("brief", 1, 60),
        F.lit("'\nNo people: "), F.col("hard").cast("string"), F.lit("  geometric: "), F.col("geometric_priority"), F.lit("  mood: "), F.col("lighting"),
    )
    rows = materialised(named.withColumns({"name": name, "folder": F.lit(""), "log": log}), "story")
    final = export.free_names(rows, "folder", "name", "source").select("idx", F.concat_ws("/", F.lit(dest.rstrip("/")), "final").alias("target"))
    report = export._put(rows.join(final, "idx").select("source", "target"), F.lit(True)).select("target", "outcome")
    return rows.join(final, "idx").join(report, "target").select("pos", "idx", "role", "score", "source", "target", "outcome", "log")
