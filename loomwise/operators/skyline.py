"""Rows that no other row dominates, by cells of a grid.

Larger is better. A row is dominated by one that is nowhere worse by more than EPS
and somewhere better by more than EPS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwise.session import forget, materialised

EPS = 1e-9
#: Cells of the grid at most, and rows of a block.
CELLS, BLOCK = 1024, 4096


def _outright(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of b some row of a beats without use of the tolerance; such rows are beaten by the best alone as well."""
    out = np.zeros(len(b), bool)
    for s in range(0, len(a), 2048):
        x = a[s : s + 2048, None]
        free = np.nonzero(~out)[0]
        out[free] = ((x >= b[free]).all(2) & (x > b[free] + EPS).any(2)).any(0)
    return out


def _beaten(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b), bool)
    for s in range(0, len(a), 1024):
        free = np.nonzero(~out)[0]
        d = a[s : s + 1024, None] - b[free]
        out[free] = ((d >= -EPS).all(2) & (d > EPS).any(2)).any(0)
    return out


def _local(x: np.ndarray) -> np.ndarray:
    """Places of the rows that none of x beats outright; nothing beats a row with a larger sum."""
    order = np.argsort(-x.sum(1), kind="stable")
    kept = np.zeros(0, np.int64)
    for s in range(0, len(order), 512):
        new = order[s : s + 512]
        new = new[~_outright(x[kept], x[new])]
        kept = np.concatenate([kept, new[~_outright(x[new], x[new])]])
    return kept


def _upto(name: str, bounds: list[float]) -> Column:
    """How many of the bounds a column reaches."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col(name)))


def skyline(df: DataFrame, cols: list[str], cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """The rows of df that no other row dominates in ``cols``; rows with a null or NaN there take no part.

    Equal rows stand and fall together, so only distinct ones are compared. Each
    task first drops what its own rows beat outright. Quantiles of each column then
    cut the space into a grid of at most ``cells`` cells. A cell is empty of front
    rows if another one with rows lies above it in every column; of the other pairs
    of cells those are compared in which one is nowhere below the other. Cells are
    compared in blocks of rows, so that neither a cell nor the front, which may
    hold all rows, meets in one task.
    """
    spark, d = df.sparkSession, len(cols)
    x = [f"x{k}" for k in range(d)]
    value = [F.col(c).cast("double").alias(n) for c, n in zip(cols, x, strict=True)]
    whole = df.select(*value).na.drop()
    for n in x:
        whole = whole.where(~F.isnan(n))

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, d))
        for b in batches:
            kept = np.concatenate([kept, b.to_numpy(float)])
            kept = kept[_local(kept)]
        if len(kept):
            yield pd.DataFrame(kept, columns=x)

    few = whole.distinct().mapInPandas(drop, ", ".join(f"{n} double" for n in x))
    few = materialised(few.withColumn("row", F.monotonically_increasing_id()), "fronts")
    parts = max(2, int(cells ** (1 / d)))
    marks = few.agg(*[F.percentile_approx(n, [k / parts for k in range(1, parts)], 100 * parts).alias(n) for n in x]).first()
    bounds = []
    for n in x:
        own: list[float] = []
        for m in sorted(set(marks[n] or [])):
            if not own or m > own[-1] + 2 * EPS:
                own.append(m)
        bounds.append(own)
    cell = F.array(*[_upto(n, own) for n, own in zip(x, bounds, strict=True)])
    placed = materialised(few.withColumn("cell", cell), "cells")
    counts = placed.groupBy("cell").count().collect()  # ``cells`` rows at most
    if not counts:
        forget(few, placed)
        return df.limit(0)
    at = np.array([r["cell"] for r in counts])
    blocks = np.array([-(-r["count"] // block) for r in counts])
    # a cell two steps up in one column and one in every other beats a cell by more than the tolerance
    over = at[:, None] - at[None]
    live = ~((over >= 1).all(2) & (over >= 2).any(2)).any(0)
    pairs = [(i, j) for j in np.nonzero(live)[0] for i in np.nonzero((over[:, j] >= -1).all(1))[0]]
    meets = spark.createDataFrame([(at[i].tolist(), int(blocks[i]), at[j].tolist(), int(blocks[j]), k) for k, (i, j) in enumerate(pairs)], "above array<int>, na int, below array<int>, nb int, pair int")
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = placed.join(F.broadcast(meets), F.col("cell") == F.col("above")).select("row", *x, F.lit(True).alias("up"), "pair", dealt("na").alias("p"), every("nb").alias("q"))
    two = placed.join(F.broadcast(meets), F.col("cell") == F.col("below")).select("row", *x, F.lit(False).alias("up"), "pair", every("na").alias("p"), dealt("nb").alias("q"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        up = g["up"].to_numpy()
        v = g[x].to_numpy(float)
        return pd.DataFrame({"row": g["row"].to_numpy()[~up][_beaten(v[up], v[~up])]}, dtype="int64")

    gone = one.unionByName(two).groupBy("pair", "p", "q").applyInPandas(compare, "row long").distinct()
    gone = gone.unionByName(placed.join(F.broadcast(spark.createDataFrame([(c.tolist(),) for c in at[~live]], "dead array<int>")), F.col("cell") == F.col("dead")).select("row"))
    front = materialised(placed.join(gone, "row", "left_anti").select(*x), "front")
    forget(few, placed)
    same = F.lit(True)
    for c, n in zip(cols, x, strict=True):
        same = same & (df[c].cast("double") == front[n])
    return df.join(front, same, "left_semi")
