"""Structured Streaming jobs: watched folders, sessions and feedback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomwise.operators.gallery import feedback_pairs
from loomwise.operators.layers import Layers


def watch(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def upsert_into(stream: DataFrame, table: Layers, checkpoint: str) -> StreamingQuery:
    """Merge each batch into a table of layers, which writes the batch's rows; a batch that is run again changes nothing."""
    write = stream.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number, checkpoint)).outputMode("update")
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, by: str, ts: str = "ts", gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key that close after a gap; rows later than ``late`` behind the newest are dropped.

    A gap of exactly the limit closes a session here, where the batch form wants more.
    """
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, by: str, ts: str = "ts", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling windows."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(by, F.col("w.start").alias("start"), "n", "total")


def histories(stream: DataFrame, by: str, item: str, at: str, keep: int = 25) -> DataFrame:
    """by and items, the last ``keep`` items of each key by the long ``at``, then item: a row a key whenever rows of it come.

    The state is the last items alone, and a batch is cut to as many as it is read,
    so a key of any number of rows takes no more memory.
    """
    kinds = dict(stream.dtypes)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held = sorted({*held, *zip(b[at].tolist(), b[item].tolist(), strict=True)})[-keep:]
        state.update(tuple(map(list, zip(*held, strict=True))))
        yield pd.DataFrame({by: [key[0]], "items": [[i for _, i in held]]})

    out, kept = f"{by} {kinds[by]}, items array<{kinds[item]}>", f"at array<bigint>, items array<{kinds[item]}>"
    return stream.select(by, item, at).groupBy(by).applyInPandasWithState(update, out, kept, "update", "NoTimeout")


def feedback_into(stream: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Pairs of winner and loser scores from changed grades (path, old_level, new_level, ts), each change once."""
    fresh = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "old_level", "new_level"])
    return append_to(feedback_pairs(fresh), path, checkpoint)
