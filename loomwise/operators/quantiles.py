"""Exact quantiles by ranges: no task holds more than a histogram, however many distinct values there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwise.session import forget, materialised


def exact_quantiles(df: DataFrame, column: str, probs: list[float], by: list[str] | None = None, bins: int = 1024) -> DataFrame:
    """by..., p and value: the quantiles of a column by group, interpolated between the two values around a rank.

    The wanted ranks of a group are looked for in rounds. Each round counts the
    rows of ``bins`` equal parts of the range in which a rank lies; the part that
    holds the rank becomes the next range, from its smallest to its largest value,
    until these are one. Counts are partial in each task, so a group may hold all
    rows. Nulls and values that aren't finite numbers take no part; a group without
    others has no row. Groups may be null.
    """
    by = by or []
    keys = [f"_k{i}" for i in range(len(by))]
    x = F.col(column).cast("double")
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    rows = materialised(rows, "values")

    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n > 0")
    asked = sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("at", F.col("p") * (F.col("n") - 1))
    places = asked.select(*keys, "lo", "hi", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    left = materialised(places.withColumn("below", F.lit(0).cast("long")), "ranges")  # a row for each wanted rank of a group
    while left.where("lo < hi").limit(1).count():
        open_ = left.where("lo < hi").select(*[F.col(k).alias(f"{k}r") for k in keys], "rank", "lo", "hi", "below")
        match = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys], F.col("x").between(F.col("lo"), F.col("hi")))
        # halves, as the difference of two large numbers may be too large for one
        part = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        counts = rows.join(open_, match).groupBy(*keys, "rank", "below", part.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin"))  # at most ``bins`` rows
        found = counts.withColumn("end", F.col("below") + upto).where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
        narrower = found.select(*keys, "lo", "hi", "rank", (F.col("end") - F.col("n")).alias("below"))
        now = materialised(left.where("lo = hi").unionByName(narrower), "ranges")
        forget(left)
        left = now
    one, two = (left.select(*[F.col(k).alias(f"{k}{s}") for k in keys], F.col("rank").alias(f"r{s}"), F.col("lo").alias(f"v{s}")) for s in "ab")
    on = lambda s, r: reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"{k}{s}")) for k in keys], F.col(f"r{s}") == r)
    value = F.col("va") + (F.col("vb") - F.col("va")) * (F.col("at") - F.floor("at"))
    out = asked.join(one, on("a", F.floor("at"))).join(two, on("b", F.ceil("at")))
    out = materialised(out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "p", value.alias("value")), "quantiles")
    forget(rows, left)
    return out
