"""Quantiles, sessions and skylines where one group, value or moment holds all or most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwise.operators import quantiles, skyline, timeline


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3001), "b": np.round(rng.exponential(size=500), 1), None: np.array([7.0]), "same": np.full(4000, -2.5), "wide": np.array([-1.7e308, 1e-300, 0.0, 1.7e308])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    for bins in (2, 1024):
        got = {(r["g"], r["p"]): r["value"] for r in quantiles.exact_quantiles(df, "x", probs, ["g"], bins if bins > 2 else 16).collect()}
        want = {(g, p): np.quantile(v / 2, p) * 2 for g, v in groups.items() for p in probs}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_quantiles_of_no_rows_and_without_groups(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert [tuple(r) for r in quantiles.exact_quantiles(df, "x", [0.5]).collect()] == [(0.5, 500.0)]
    assert quantiles.exact_quantiles(df.where("x < 0"), "x", [0.5]).count() == 0


def test_no_task_holds_all_values(spark):
    """The plan of a round has partial counts, not a state of all values."""
    text = quantiles.exact_quantiles(spark.range(100).select(F.col("id").cast("double").alias("x")), "x", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in text.lower()


def sessions(rows, gap=900.0):
    out, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (repr(r[1]), r[2] is not None, r[2] or 0, r[0])):
        before, n = last.get(k, (None, 0))
        n += before is not None and t is not None and t - before > gap
        out[i], last[k] = n, (t, n)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_sessions_of_one_key_with_most_rows(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, "hot", float(t)) for i, t in enumerate(rng.integers(0, 3_000_000, 6000))] + [(10_000 + i, "hot", 77.0) for i in range(3000)]
    rows += [(20_000 + i, f"k{i % 9}", float(t)) for i, t in enumerate(rng.integers(0, 9000, 90))] + [(30_000 + i, None, float(1000 * i)) for i in range(5)] + [(40_000, "hot", None), (40_001, "late", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = timeline.segment_events(spark.createDataFrame(rows, "id long, k string, exif_ts double"), ["k"])
        assert got.columns == ["id", "k", "exif_ts", "event"]
        assert {r["id"]: r["event"] for r in got.collect()} == sessions(rows)
        one = [(i, "x", t) for i, _, t in rows]
        got = timeline.events_by_range(spark.createDataFrame(one, "id long, k string, exif_ts double"))
        assert {r["id"]: r["event"] for r in got.collect()} == sessions(one)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_key_is_spread_over_ranges(spark):
    df = spark.range(40_000).select(F.col("id"), F.lit("hot").alias("k"), (F.col("id") * 3.0).alias("exif_ts"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in df.repartitionByRange("k", "exif_ts", "id").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 15_000
        assert timeline.segment_events(df, ["k"]).agg(F.max("event")).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def front(x):
    return {i for i in range(len(x)) if not ((x >= x[i] - 1e-9).all(1) & (x > x[i] + 1e-9).any(1)).any()}


@pytest.mark.parametrize("kind", ["anti", "random", "ties", "near"])
def test_skyline_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.random((900, 3))
    if kind == "anti":  # nearly all rows are in the front
        x /= x.sum(1, keepdims=True)
    if kind == "ties":
        x = np.round(x, 1)
    if kind == "near":  # differences around the tolerance
        x = np.round(x, 1) + rng.integers(-3, 4, x.shape) * 4e-10
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    odd = spark.createDataFrame([(-1, None, 5.0, 5.0), (-2, float("nan"), 5.0, 5.0)], df.schema)
    for cells, block in ((1024, 4096), (64, 50)):
        got = skyline.skyline(df.union(odd).repartition(4), ["a", "b", "c"], cells, block)
        assert {r["i"] for r in got.collect()} == front(x)
    assert kind != "anti" or len(front(x)) > 600
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_skyline_of_one_repeated_row(spark):
    df = spark.range(5000).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    assert skyline.skyline(df, ["a", "b"]).count() == 5000
    assert skyline.skyline(df.where("id < 0"), ["a", "b"]).count() == 0
