"""All queries of the library's own operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwise.queries import briefs, grading, sequences, similar, streams, tables

MODULES = [grading, similar, sequences, tables, streams, briefs]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, drop duplicates, pick a sequence."""
    return tables.flagship_sequence(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
