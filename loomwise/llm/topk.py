"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers, floor(64 x). A vector is cut into equal segments; with
a segment's mean and its root sum of squared deviations, the inner product of
two segments of m components is at most m * mean * mean' + dev * dev' (Cauchy
and Schwarz). Since the squared distance is the sum of the squared norms less
twice the inner product, this upper bound is the lower bound on the distance.
Bounds go from coarse to fine segments; only pairs whose bound reaches the
query's k-th best score so far are kept, and exact scores are computed for the
survivors.

The stated queries meet all rows in blocks: rows are dealt into query blocks and
candidate blocks by a hash of the id, each pair of blocks is one group, and the
best k of each group are merged by a window. One block of candidates goes first
and gives every query a floor for its k-th best score before the others start.

Defined results. Null vectors, vectors with a null or non-finite component, and
rows with a null id take no part. A shorter vector is filled up with zeros. Of
rows that repeat an id, the largest vector stands. Ties go to the smaller id; a
query with fewer candidates than k gets all of them. Vectors of any length and
components of any size give exact scores, held to the range of a long: sums of
products are taken where float64 holds them exactly, over DIMS components at a
time, and of large components over limbs of 20 bits. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwise.llm.common import written

LEVELS = (4, 16)
#: Bits of a component, and components, whose products float64 adds up without rounding.
LIMB, DIMS = 20, 1024
COLUMNS = 2048
NONE = np.iinfo(np.int64).min
LONG = (-(1 << 63), (1 << 63) - 1)


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers of up to LIMB bits, in int64."""
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, x.shape[1], DIMS):
        out += (x[:, at : at + DIMS] @ y[:, at : at + DIMS].T).astype(np.int64)
    return out


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """The lowest four limbs of whole numbers in two's complement; what is above doesn't count in 64 bits."""
    cut = [np.floor(x / 2.0 ** (LIMB * k)) for k in range(5)]
    return [low - high * 2.0**LIMB for low, high in zip(cut, cut[1:], strict=False)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers in float64, held to the range of a long."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= 1 << LIMB:
        return _dot(x, y)
    total = np.zeros((len(x), len(y)), np.uint64)
    a, b = _limbs(x), _limbs(y)
    for i in range(4):
        for j in range(4 - i):  # further ones are multiples of 2^64
            total += _dot(a[i], b[j]).view(np.uint64) << np.uint64(LIMB * (i + j))
    out = total.view(np.int64).copy()
    with np.errstate(over="ignore", invalid="ignore"):
        near, slack = x @ y.T, (np.abs(x) @ np.abs(y).T) * (x.shape[1] + 4) * 2.0**-52
        sure = np.abs(near) + slack < 2.0**62
    for i, j in zip(*np.nonzero(~sure), strict=True):  # near or beyond the range of a long: in whole numbers without bound
        value = sum(int(p) * int(q) for p, q in zip(x[i], y[j], strict=True))
        out[i, j] = min(max(value, LONG[0] + 1), LONG[1])
    return out


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """floor(64 x) as float64, one row for each vector, filled up with zeros."""
    sizes = np.asarray(lists.value_lengths())
    flat = np.floor(64 * np.asarray(lists.flatten(), np.float64))
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def bounds(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of x from above: scaled means, then deviations, of each segment."""
    width = -(-x.shape[1] // segments)
    x = np.pad(x, ((0, 0), (0, width * segments - x.shape[1]))).reshape(len(x), segments, width)
    mean = x.mean(2)
    dev = np.sqrt(((x - mean[:, :, None]) ** 2).sum(2))
    return np.concatenate([mean * np.sqrt(width), dev], 1)


def _best(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int):
    """(query row, score, id) of the best k candidates of each query that reach its floor."""
    order = np.argsort(cid, kind="stable")
    c, cid = c[order], cid[order]
    rows, scores, ids = (np.zeros(0, np.int64) for _ in range(3))
    floor = floor.copy()
    small = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    bounded = small < 1e100  # beyond, squares leave the range of float64
    norm = np.sqrt((q**2).sum(1)).max(initial=0) if bounded else 0
    q_levels = [bounds(q, s) for s in LEVELS] if bounded else []
    for at in range(0, len(c), COLUMNS):
        part, pid = c[at : at + COLUMNS], cid[at : at + COLUMNS]
        alive = np.ones((len(q), len(part)), bool)
        for s, ql in zip(LEVELS, q_levels, strict=False):
            slack = 1e-9 * norm * np.sqrt((part**2).sum(1)).max(initial=0) + 1e-3
            least = np.where(floor == NONE, -np.inf, floor.astype(float)) - slack
            on, cols = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
            if not len(on):
                break
            alive[np.ix_(on, cols)] &= ql[on] @ bounds(part[cols], s).T >= least[on, None]
        on, cols = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
        if not len(on):
            continue
        if alive.sum() < 0.05 * len(on) * len(cols) and small <= 1 << LIMB and q.shape[1] <= DIMS:  # few survivors: one by one
            r, j = np.nonzero(alive)
            value = np.einsum("ij,ij->i", q[r], part[j]).astype(np.int64)
        else:
            exact = products(q[on], part[cols])
            exact[~alive[np.ix_(on, cols)] | (qid[on, None] == pid[cols])] = NONE
            # all that reach the k-th best of these columns: ties are settled below
            at_k = np.partition(exact, exact.shape[1] - k, axis=1)[:, -k] if exact.shape[1] > k else np.full(len(on), NONE)
            r, j = np.nonzero((exact >= at_k[:, None]) & (exact != NONE))
            value, r, j = exact[r, j], on[r], cols[j]
        real = qid[r] != pid[j]
        r, j, value = r[real], j[real], value[real]
        rows, scores, ids = np.concatenate([rows, r]), np.concatenate([scores, value]), np.concatenate([ids, pid[j]])
        o = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[o], scores[o], ids[o]
        start = np.searchsorted(rows, np.arange(len(q)))
        place = np.arange(len(rows)) - start[rows]
        keep = place < k
        last = place == k - 1
        floor[rows[last]] = np.maximum(floor[rows[last]], scores[last])
        rows, scores, ids = rows[keep], scores[keep], ids[keep]
    return rows, scores, ids


def _group(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        is_query = t.column("q").to_numpy()
        ids, floors = t.column("id").to_numpy(), t.column("floor").fill_null(NONE).to_numpy()
        if is_query.all() or not is_query.any():
            return schema.empty_table()
        # vectors of like length are padded to the longest of them; beyond a query's or a candidate's end products are 0
        column = t.column("v").combine_chunks()
        size = np.asarray(column.value_lengths())
        like = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        out = []
        classes = [[(at, _matrix(column.take(pa.array(at)), max(1, int(size[at].max())))) for kind in np.unique(like[side]) for at in [np.nonzero(side & (like == kind))[0]]] for side in (is_query, ~is_query)]
        for q_at, q in classes[0]:
            for c_at, c in classes[1]:
                dims = min(q.shape[1], c.shape[1])
                rows, scores, found = _best(q[:, :dims], ids[q_at], floors[q_at], c[:, :dims], ids[c_at], k)
                out.append(pa.table([ids[q_at][rows], found, scores], schema=schema))
        return pa.concat_tables(out)

    return run


def exact_top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, query_rows: int = 2048, candidate_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best of all other rows for each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    """
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull()).where(usable).groupBy("vec_id").agg(F.max("embedding").alias("v"))
    rows = written(spark, rows.select(F.col("vec_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), is_query.alias("is_query")), "vectors")
    n, m = rows.agg(F.count("*"), F.count_if("is_query")).first()
    n_c, n_q = max(1, -(-n // candidate_rows)), max(1, -(-m // query_rows))
    block = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "v", F.lit(False).alias("q"), F.lit(None).cast("long").alias("floor"), block(1, n_c).alias("cb"), all_of(n_q).alias("qb"))
    queries = rows.where("is_query").select("id", "v", F.lit(True).alias("q"), block(2, n_q).alias("qb"))
    out = "query_id long, vec_id long, score long"

    first = queries.select("id", "v", "q", F.lit(None).cast("long").alias("floor"), F.lit(0).alias("cb"), "qb")
    seed = written(spark, candidates.where("cb = 0").unionByName(first).groupBy("qb", "cb").applyInArrow(_group(k), out), "seed")
    found = seed
    if n_c > 1:
        floors = seed.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")
        rest = queries.join(floors, queries.id == floors.query_id, "left").select("id", "v", "q", "floor", F.explode(F.sequence(F.lit(1), F.lit(n_c - 1))).alias("cb"), "qb")
        found = found.unionByName(candidates.where("cb > 0").unionByName(rest).groupBy("qb", "cb").applyInArrow(_group(k), out))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark, sf_dir):
    return exact_top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
