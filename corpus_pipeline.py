"""Corpus preparation: language ID, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes what a stage returns as Parquet in the shared folder and reads it again
as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwise.llm.bpe import encode_documents
from loomwise.llm.common import broadcast_if_small, forget, fresh, row_key, written
from loomwise.llm.decontaminate import decontaminate
from loomwise.llm.langid import train
from loomwise.llm.line_dedup import dedup_lines
from loomwise.llm.near_dup import near_duplicates

#: A prediction with less than this share of the posterior is no language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters or with an unsure prediction go; a missing lang is filled in.

    Where no document has a lang to learn from, all with letters stay.
    """
    columns = docs.columns
    model = train(spark, docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = fresh(columns, "lang_pred", "score")
    kept = model.predict(docs, (pred, score)).where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three documents share, but for the largest doc_id that holds them."""
    columns = docs.columns
    kept, n, dropped = fresh(columns, "kept_text", "n_lines", "n_dropped")
    found = dedup_lines(spark, docs, (kept, n, dropped)).withColumn("text", F.when(F.col(dropped) > 0, F.col(kept)).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; rows without doc_id stay.

    Rows that repeat a doc_id with other text are documents of their own; of a
    group's rows with the smallest doc_id the longest text stays.
    """
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_dedup_rows(spark, docs)
    kept = near_duplicates(spark, docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = broadcast_if_small(written(spark, kept, "kept"))
    one = docs.join(kept, "doc_id", "left_semi")
    return one.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def _near_dedup_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same where ids repeat: doc_id and text together are a row's key."""
    key, place = fresh(docs.columns, "row_id", "row_place")
    keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("doc_id", row_key(F.col("text"))))
    ids = keyed.select(F.col(key).alias("u"), "doc_id", "text").dropDuplicates(["u"])
    found = near_duplicates(spark, ids.select(F.col("u").alias("doc_id"), "text")).select(F.col("doc_id").alias("u"), "component_id")
    order = F.struct("doc_id", -F.length("text"), "u")
    kept = ids.join(found, "u").groupBy("component_id").agg(F.min_by("u", order).alias(key)).select(key)
    kept = broadcast_if_small(written(spark, kept, "kept"))
    # rows that repeat as a whole text under one id: one of them
    again = Window.partitionBy(key).orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], "doc_id")
    one = keyed.join(kept, key, "left_semi").withColumn(place, F.row_number().over(again)).where(F.col(place) == 1)
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of every document."""
    return encode_documents(docs, decode=False).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Language ID, BPE and near-duplicate groups over joined links are beyond a SQL statement; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(spark, stage(spark, docs, sf_dir), name)
        if k:
            forget(before)
    return docs
