"""Events by time gaps, bursts inside them, and orders in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwise.operators import similarity
from loomwise.session import materialised


def segment_events(df: DataFrame, by: list[str], ts: str = "exif_ts", id_: str = "id", gap: float = 900.0) -> DataFrame:
    """Add event (from 0) within each group: a new one when more than ``gap`` seconds pass.

    Rows are sorted by ranges of group, time and id, so a group, or one moment of
    it, may hold all rows. Events are numbered inside each range; a table with a row
    for each group in each range, its first and last time and its number of starts,
    carries the numbers on from range to range. A group without any time stamp (all
    0) is one event, as all its gaps are 0; rows without a time come first.
    """
    part, start, inside, base = "_part", "_start", "_in", "_base"
    ranged = df.repartitionByRange(*by, ts, id_).withColumn(part, F.spark_partition_id())
    rows = materialised(ranged, "ranges")  # the ranges stay what they are when a task is run again
    w = Window.partitionBy(part, *by).orderBy(ts, id_)
    inner = rows.withColumn(start, F.when(F.col(ts) - F.lag(ts).over(w) > gap, 1).otherwise(0)).withColumn(inside, F.sum(start).over(w))
    edge = inner.groupBy(part, *by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.sum(start).alias("_n"))
    order = Window.partitionBy(*by).orderBy(part)  # a row a range at most
    jump = F.when(F.col("_lo") - F.lag("_hi").over(order) > gap, 1).otherwise(0)
    edge = edge.withColumn("_jump", jump).withColumn(base, F.sum("_jump").over(order) + F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = edge.select(F.col(part).alias("_p"), *[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], base)
    same = F.col(part) == F.col("_p")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    return inner.join(edge, same).withColumn("event", F.col(base) + F.col(inside)).select(*df.columns, "event")


def events_by_range(df: DataFrame, ts: str = "exif_ts", id_: str = "id", gap: float = 900.0) -> DataFrame:
    """Segment one global timeline."""
    return segment_events(df, [], ts, id_, gap)


def consolidate_bursts(df: DataFrame, by: list[str], window_s: float = 30.0, limit: float = 0.6) -> DataFrame:
    """One hero a burst, with burst_size: within a group the first free row takes later rows nearer than ``limit``.

    Distance is 1 - cos plus the time difference over ``window_s`` (without time
    stamps: no time part). df has id, v, exif_ts, score and the group's columns.
    The first rows of bursts are those that no earlier first row is near; they are
    found in rounds over ranges of time, and every other row goes to the earliest
    first row near it. Near pairs come from blocks, so a group may be of any size.
    """
    timed = df.groupBy(*by).agg((F.max("exif_ts") > 0).alias("_timed"))
    gap = F.when(F.col("_timed") & F.lit(window_s > 0), F.col("exif_ts")).otherwise(0.0)
    ranged = df.join(timed, by).select(*by, "id", "v", "exif_ts", "score", gap.alias("t")).repartitionByRange(*by, "exif_ts", "id")
    rows = materialised(ranged.withColumn("part", F.spark_partition_id()), "rows")
    near = similarity.near_pairs(rows, by, limit, window_s or 1.0)
    order = lambda s: F.struct(F.col(f"ts_{s}"), F.col(s))
    times = lambda s: rows.select(F.col("id").alias(s), F.col("exif_ts").alias(f"ts_{s}"), F.col("part").alias(f"part_{s}"))
    timed = near.join(times("a"), "a").join(times("b"), "b")
    first = order("a") < order("b")
    early = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    both = timed.select(early("a", "b").alias("better"), early("b", "a").alias("worse"), early("ts_a", "ts_b").alias("ts"), early("ts_b", "ts_a").alias("at"), early("part_a", "part_b").alias("better_part"), early("part_b", "part_a").alias("worse_part"))
    both = materialised(both, "near")
    heads = similarity.first_in_order(rows, both.drop("ts"))
    taken = both.join(heads.select(F.col("id").alias("better")), "better", "left_semi").groupBy(F.col("worse").alias("id")).agg(F.min(F.struct("ts", "better")).alias("m")).select("id", F.col("m.better").alias("head"))
    taken = taken.join(heads, "id", "left_anti").unionByName(heads.select("id", F.col("id").alias("head")))
    best = F.max(F.struct("score", (-F.col("id")).alias("o"))).alias("m")
    hero = rows.join(taken, "id").groupBy(*by, "head").agg(best, F.count("*").alias("burst_size"))
    return hero.select(*by, (-F.col("m.o")).alias("id"), F.col("m.score").alias("score"), "burst_size")


def in_time_order(df: DataFrame, ts: str = "exif_ts") -> DataFrame:
    return df.orderBy(ts, "id")


def event_index(by: list[str], event: str = "event") -> Column:
    """Events numbered densely from 0 within a group."""
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(event)) - 1
