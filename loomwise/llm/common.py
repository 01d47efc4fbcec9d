"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.session import remove_path, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a side of a join may be broadcast, if its rows are small.
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that no column has (Spark tells no case apart): each with as many underscores in front as it takes."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def others(columns: list[str], *names: str) -> list[str]:
    """The columns but those with one of these names."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of at most ``rows`` rows and, unless one row has more, ``size`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


_HELD: dict = {}


def held(key, make: Callable):
    """What a worker keeps from task to task: one thing, so that operators that follow each other don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def row_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with other text; the same on every attempt of a task."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing will read again."""
    for df in tables:
        remove_path(df.sparkSession, df.scratch)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only if its counted rows are within the bound; else Spark joins by shuffle.

    Call it on a written table, where counting is cheap.
    """
    return F.broadcast(df) if df.count() <= rows else df
