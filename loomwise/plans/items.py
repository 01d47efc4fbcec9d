"""The item table and prompt vectors, taken from the embeddings and event tables.

Vectors 0 to 35 are prompts: 14 positive, 5 negative, 5 aspects each positive and
negative, then fine art, five archetypes and people. All later vectors are items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.functions.vectors import doubles, norm, unit

PROMPTS = 36
ASPECTS = ["tech", "comp", "light", "narr", "human"]
#: Notes that stand for an item's log, by id.
NOTES = [
    "Wide establishing exterior skyline",
    "Person portrait, decisive expression",
    "Dramatic shadow and contrast",
    "Macro texture detail",
    "Vanishing depth, horizon",
    "Empty interior corridor, geometry",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label and unit vector v of every embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("e"))
    return e.withColumn("n", norm(F.col("e"))).select("id", "label", unit(F.col("e"), F.col("n")).alias("v"))


def prompts(vectors: DataFrame) -> DataFrame:
    """One row: ``ps``, the prompt vectors in order. Of fixed size."""
    few = vectors.where(F.col("id") < PROMPTS)
    return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda s: s.v).alias("ps"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, path, label, v, exif_ts, lum, lum_std, faces, personal and log of each item."""
    base = units(spark, sf_dir).where(F.col("id") >= PROMPTS)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("exif_ts"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    note = F.get(F.array(*map(F.lit, NOTES)), (F.col("id") % len(NOTES)).cast("int"))
    return (
        base.join(events, "id", "left")
        .join(labels, "id", "left")
        .select(
            F.col("id").alias("idx"),
            F.concat(F.lit("item_"), F.col("id")).alias("path"),
            "label",
            "v",
            F.coalesce("exif_ts", F.lit(0.0)).alias("exif_ts"),
            ((F.col("id") * 37) % 256).cast("double").alias("lum"),
            ((F.col("id") * 53) % 100).cast("double").alias("lum_std"),
            (F.col("id") % 4).cast("int").alias("faces"),
            F.coalesce(F.col("quality") * 0.6 + 0.2, F.lit(0.5)).alias("personal"),
            note.alias("log"),
        )
    )


#: The same in SQL: CTEs u (unit vectors) and it (items).
SQL = f"""
n0 AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
u AS (SELECT id, label, list_transform(e, lambda x: x / (n + 1e-9)) AS v FROM n0),
it AS (
  SELECT u.id AS idx, 'item_' || u.id AS path, u.label, v, coalesce(floor(epoch(ts)), 0.0) AS exif_ts,
         CAST((u.id * 37) % 256 AS DOUBLE) AS lum, CAST((u.id * 53) % 100 AS DOUBLE) AS lum_std, CAST(u.id % 4 AS INTEGER) AS faces,
         coalesce(quality * CAST(0.6 AS DOUBLE) + 0.2, 0.5) AS personal,
         {NOTES!r}[(u.id % {len(NOTES)}) + 1] AS log
  FROM u LEFT JOIN events ON event_id = u.id LEFT JOIN labels ON doc_id = u.id WHERE u.id >= {PROMPTS})"""
