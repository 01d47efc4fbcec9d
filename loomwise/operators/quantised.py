"""An inverted file of product-quantised vectors: searches by tables of partial products, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwise.functions.vectors import dot
from loomwise.operators.similarity import dots
from loomwise.session import forget, materialised

#: Vectors of a stored block, and queries that meet it at once.
BLOCK, ASKED = 4096, 512


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k centres of some rows by k-means; fewer if there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, c, k) for c in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class ProductIndex:
    """Vectors by the cells of their ``copies`` nearest centres, each as one byte a part of its difference from the centre.

    Centres and codebooks are fitted on at most ``sample`` rows, those with the
    smallest hashes; all rows are stored, in blocks of a cell. A stored vector takes
    ``copies`` * (12 + ``parts``) bytes: its id, its bytes and how far they are off.

    A search looks into the cells of the ``probes`` nearest centres. The dot product of
    a query and a stored vector is about that with the centre plus one entry of a
    table for each part; the ``rerank`` best by it get their exact products. With
    ``rerank=None`` all rows are re-ranked that the k best could hold, as a product is
    off by no more than the length of the query times what the bytes are off, so the
    result is exact in the probed cells, and exact with all cells probed. That happens
    where the block is read, from a second copy of the blocks that has the vectors
    beside the bytes and is made for the first such search; a block hands on its k
    best rows of a query alone.
    """

    def __init__(self, rows: DataFrame, cells: int = 16, parts: int = 16, codes: int = 256, copies: int = 2, sample: int = 20_000, seed: int = 42, block: int | None = None):
        if codes > 256:
            raise ValueError("a part has one byte")
        spark = rows.sparkSession
        self.rows = materialised(rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL"), "vectors")
        few = self.rows.orderBy(F.xxhash64("id"), "id").limit(sample)
        # one task each: the centres, then a codebook for each part, from the sample alone
        fit = few.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda g: pd.DataFrame({"c": [x.tolist() for x in lloyd(np.stack(g["v"].to_numpy()), cells, seed)]}), "c array<double>")
        self.centres = np.array([r["c"] for r in fit.collect()]).reshape(-1, max(1, self._size()))
        self.copies = min(copies, max(1, len(self.centres)))
        self.blocks, self.exact, self.books, self.spans = None, None, [], []
        if not len(self.centres):
            return
        d = self.centres.shape[1]
        self.parts = min(parts, d)
        ends = np.cumsum([len(p) for p in np.array_split(np.arange(d), self.parts)])
        self.spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        centres, spans = self.centres, self.spans

        def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.stack(b["v"].to_numpy())
                    x = x - centres[_nearest(x, centres)]
                    for j, (s, e) in enumerate(spans):
                        yield pd.DataFrame({"part": j, "x": list(x[:, s:e])})

        def book(g: pd.DataFrame) -> pd.DataFrame:
            part = int(g["part"].iloc[0])
            return pd.DataFrame({"part": part, "c": [lloyd(np.stack(g["x"].to_numpy()), codes, seed + part).reshape(-1).tolist()]})

        found = few.mapInPandas(residuals, "part int, x array<double>").groupBy("part").applyInPandas(book, "part int, c array<double>").collect()
        self.books = [np.array(r["c"]).reshape(-1, e - s) for r, (s, e) in zip(sorted(found), spans, strict=True)]
        # four blocks a cell, so that their number doesn't grow with the rows
        self.block = block or min(8 * BLOCK, max(BLOCK, -(-self.rows.count() * self.copies // (4 * len(self.centres)))))
        self.blocks, self.exact = self._stored(spark, self.block), None

    def _size(self) -> int:
        one = self.rows.select(F.size("v").alias("n")).first()
        return one["n"] if one else 0

    @property
    def bytes_a_vector(self) -> int:
        return self.copies * (12 + self.parts)

    def _stored(self, spark, block: int, vectors: bool = False) -> DataFrame:
        """Blocks of a cell: ids, bytes and errors, and if asked for the vectors themselves."""
        centres, books, spans, copies = self.centres, self.books, self.spans, self.copies

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                x = np.stack(b["v"].to_numpy())
                far = (centres * centres).sum(1) - 2 * x @ centres.T
                near = np.argsort(far, axis=1, kind="stable")[:, :copies]
                for c in range(copies):
                    rest = x - centres[near[:, c]]
                    code, off = np.empty((len(x), len(spans)), np.uint8), np.zeros(len(x))
                    for j, (s, e) in enumerate(spans):
                        code[:, j] = _nearest(rest[:, s:e], books[j])
                        off += ((rest[:, s:e] - books[j][code[:, j]]) ** 2).sum(1)
                    yield pd.DataFrame({"cell": near[:, c].astype(np.int32), "id": b["id"].to_numpy(), "code": [r.tobytes() for r in code], "off": np.sqrt(off)} | ({"v": b["v"].to_numpy()} if vectors else {}))

        coded = materialised(self.rows.mapInPandas(encode, "cell int, id long, code binary, off double" + ", v array<double>" * vectors), "codes")
        sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))  # a row a cell
        dealt = coded.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))

        def pack(g: pd.DataFrame) -> pd.DataFrame:
            # rounded up, so that the bound holds
            off = np.nextafter(g["off"].to_numpy().astype(np.float32), np.float32(np.inf)) + np.float32(1e-6)
            return pd.DataFrame({"cell": [g["cell"].iloc[0]], "ids": [g["id"].to_numpy().astype("<i8").tobytes()], "codes": [b"".join(g["code"])], "off": [off.astype("<f4").tobytes()]} | ({"vs": [np.stack(g["v"].to_numpy()).astype("<f8").tobytes()]} if vectors else {}))

        out = materialised(dealt.groupBy("cell", "block").applyInPandas(pack, "cell int, ids binary, codes binary, off binary" + ", vs binary" * vectors), "blocks")
        forget(coded)
        return out

    def search(self, queries: DataFrame, k: int = 20, probes: int = 10, rerank: int | None = 200, asked: int = ASKED) -> DataFrame:
        """query_id, rank, id and cos of the k best other rows for queries (id, v)."""
        kind = "query_id long, rank int, id long, cos double"
        if self.blocks is None:
            return queries.sparkSession.createDataFrame([], kind)
        centres, books, spans, parts = self.centres, self.books, self.spans, len(self.spans)
        probes = min(probes, len(centres))
        own = queries.select(F.col("id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("q")).where("query_id IS NOT NULL AND q IS NOT NULL")

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.stack(b["q"].to_numpy())
                    near = np.argsort((centres * centres).sum(1) - 2 * x @ centres.T, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"cell": near.reshape(-1).astype(np.int32), "query_id": np.repeat(b["query_id"].to_numpy(), probes), "q": np.repeat(b["q"].to_numpy(), probes)})

        at = own.mapInPandas(cells, "cell int, query_id long, q array<double>")
        n = F.lit(max(1, -(-own.count() // asked)))
        pack = lambda g: pd.DataFrame({"cell": [g["cell"].iloc[0]], "queries": [g["query_id"].to_numpy().astype("<i8").tobytes()], "qs": [np.stack(g["q"].to_numpy()).astype("<f8").tobytes()]})
        packed = at.withColumn("part", F.pmod(F.xxhash64("query_id"), n)).groupBy("cell", "part").applyInPandas(pack, "cell int, queries binary, qs binary")

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    ids, who = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.queries, "<i8")
                    code, off = np.frombuffer(r.codes, np.uint8).reshape(-1, parts), np.frombuffer(r.off, "<f4").astype(float)
                    q = np.frombuffer(r.qs, "<f8").reshape(len(who), -1)
                    about = np.repeat((q @ centres[r.cell])[:, None], len(ids), 1)
                    for j, (s, e) in enumerate(spans):
                        about += (q[:, s:e] @ books[j].T)[:, code[:, j]]
                    about[who[:, None] == ids[None]] = -np.inf
                    top = np.argpartition(-about, min(rerank, len(ids)) - 1, axis=1)[:, :rerank]
                    i, j = np.repeat(np.arange(len(who)), top.shape[1]), top.reshape(-1)
                    keep = np.isfinite(about[i, j])
                    i, j = i[keep], j[keep]
                    yield pd.DataFrame({"query_id": who[i], "id": ids[j], "about": about[i, j]})

        def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The k best rows of a block for each query, exactly: those best by their bytes set a limit that the bounds of all others are held against."""
            for b in batches:
                for r in b.itertuples():
                    ids, who = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.queries, "<i8")
                    code, off = np.frombuffer(r.codes, np.uint8).reshape(-1, parts), np.frombuffer(r.off, "<f4").astype(float)
                    q, v = np.frombuffer(r.qs, "<f8").reshape(len(who), -1), np.frombuffer(r.vs, "<f8").reshape(len(ids), -1)
                    base, tables, size = q @ centres[r.cell], [q[:, s:e] @ books[j].T for j, (s, e) in enumerate(spans)], np.linalg.norm(q, axis=1)
                    asks, rows = [], []
                    for i in range(len(who)):
                        about = np.full(len(ids), base[i])
                        for j, t in enumerate(tables):
                            about += t[i][code[:, j]]
                        own = ids == who[i]
                        about[own] = -np.inf
                        at = np.flatnonzero(~own)
                        if len(at) > k:
                            first = np.argpartition(-about, k - 1)[:k]
                            least = (v[first] @ q[i]).min()
                            at = np.flatnonzero((about + size[i] * off >= least - 1e-9) & ~own)
                            exact = v[at] @ q[i]
                            at = at[exact >= -np.partition(-exact, k - 1)[k - 1] - 1e-9] if len(at) > k else at
                        asks.append(np.full(len(at), i))
                        rows.append(at)
                    i, j = np.concatenate(asks), np.concatenate(rows)
                    yield pd.DataFrame({"query_id": who[i], "id": ids[j], "cos": dots(q, i, v, j)})

        if rerank is None:
            if self.exact is None:
                self.exact = self._stored(queries.sparkSession, self.block, vectors=True)
            found = packed.join(self.exact, "cell").mapInPandas(settled, "query_id long, id long, cos double")
            # a row stored in two cells comes twice
            found = found.groupBy("query_id", "id").agg(F.max("cos").alias("cos"))
            last = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
            return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "id", "cos")
        near = packed.join(self.blocks, "cell").mapInPandas(scored, "query_id long, id long, about double")
        # a row stored in two cells comes twice; its better estimate stands
        near = near.groupBy("query_id", "id").agg(F.max("about").alias("about"))
        order = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
        few = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rerank)
        exact = few.select("query_id", "id").join(self.rows, "id").join(own, "query_id").select("query_id", "id", dot(F.col("q"), F.col("v")).alias("cos"))
        last = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
        return exact.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "id", "cos")

    def close(self) -> None:
        """Delete the stored tables."""
        forget(self.rows, *(t for t in (self.blocks, self.exact) if t is not None))


