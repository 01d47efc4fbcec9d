"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct 5-word shingles as 64-bit hashes. Its signature
has ``positions`` symbols of ``bits`` bits, each the low bits of a minimum hash.
The threshold on the number of differing symbols is set so that a pair at the
wanted similarity exceeds it with a chance of about one in a million. By the
pigeonhole principle a pair within the threshold has a chunk of the signature
with at most ``errors`` differing symbols, of ``(threshold + 1) / (errors + 1)``
chunks; so each chunk is indexed once for every choice of ``errors`` symbols to leave out, and every pair
within the threshold meets in some key.

Documents with equal sets are one class from the start. Keys are over class
representatives. Within a key, members are first paired with one of them only,
that which shares most keys with others, so that the many keys of a large group
agree on few; confirmed links are closed into components. Then what a key still holds
in different components is compared, the minority of the key against all its
other components, so that no link is lost and copies are never expanded into
all pairs. This is done on arrays in blocks of bounded size: a longer signature
of the documents concerned rules out most, by a threshold of its own set in the
same way, and a pair is put out by its first common key alone. Every link is
confirmed on the full sets.

Defined results. Null texts and texts without words have an empty set and are
linked with nothing, not even with each other. Fewer words than a shingle make
one shingle of the whole sequence. Rows that repeat a doc_id are one document
with their sets joined; a null doc_id is reported alone and never linked. Very
long texts are taken whole. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.llm.common import broadcast_if_small, forget, held, slices, written

WIDTH = 5
POSITIONS, ERRORS, BITS = 60, 1, 16
#: Of the longer signature that is compared within keys.
FINE_POSITIONS, FINE_BITS = 512, 8
#: Members of a key that one block holds.
BLOCK = 2048
#: Texts taken at once, and their bytes.
ROWS, SIZE = 512, 4 << 20
M64 = (1 << 64) - 1
CACHE = 200_000


def allowed(positions: int, similarity: float, bits: int, miss: float = 3e-6) -> int:
    """The smallest threshold that a pair of this similarity exceeds with at most the chance ``miss``."""
    from math import comb

    q = (1 - similarity) * (1 - 2.0**-bits)
    tail = 1.0
    for t in range(positions + 1):
        tail -= comb(positions, t) * q**t * (1 - q) ** (positions - t)
        if tail <= miss:
            return t
    return positions


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, w: bytes) -> int:
        # up to seven bytes and their number are the hash themselves
        h = int.from_bytes(w, "little") | len(w) << 56 if len(w) < 8 else int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self) >= CACHE:
            self.clear()
        self[w] = h
        return h


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = held("words", _Words)
    h = _mix(np.fromiter([known[w] for w in words], np.uint64, len(words)))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


class Signer:
    """Signatures of shingle sets: ``positions`` symbols of ``bits`` bits."""

    def __init__(self, positions: int, bits: int):
        r = np.random.default_rng(20240607)
        self.a = r.integers(1, M64, positions, np.uint64) | np.uint64(1)
        self.bits = bits

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of symbols for each set; the sets are not empty."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.a)), np.int64)
        for k, a in enumerate(self.a):
            # multiply and keep the high half: the order of the products is that of a random hash
            low = np.minimum.reduceat((flat * a) >> np.uint64(24), starts)
            out[:, k] = (_mix(low) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return out


def keys_of(symbols: np.ndarray, chunks: int, errors: int) -> np.ndarray:
    """The index keys of each signature: every chunk with every choice of ``errors`` symbols left out."""
    out, edges = [], np.linspace(0, symbols.shape[1], chunks + 1).astype(int)
    tag = 0
    for a, b in zip(edges, edges[1:], strict=False):
        for gone in combinations(range(a, b), min(errors, b - a)):
            tag += 1
            key = np.full(len(symbols), tag, np.uint64)
            for c in range(a, b):
                if c not in gone:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, c].astype(np.uint64))
            out.append(key.view(np.int64))
    return np.stack(out, 1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, m = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(rows.reshape(-1)))


def signatures(docs: DataFrame, positions: int = POSITIONS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, fp (of the set; null if empty) and sig (null if empty) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(positions, bits)
        for whole in batches:
            for part in slices(whole, ROWS, SIZE):
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                sigs: list = [None] * len(sets)
                if full:
                    for k, s in zip(full, sign([sets[k] for k in full]), strict=True):
                        sigs[k] = s.astype("<u2").tobytes() if bits <= 16 else s.tobytes()
                fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, sig binary")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and the hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, ROWS, SIZE):
                sets = [shingles(t, width).view(np.int64) for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["doc_id", "grams"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, grams array<long>")


def index_keys(reps: DataFrame, positions: int, chunks: int, errors: int, bits: int) -> DataFrame:
    """id and each of its index keys, from (id, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                symbols = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2" if bits <= 16 else np.int64).reshape(-1, positions)
                yield pa.RecordBatch.from_arrays([b.column("id"), _lists(keys_of(symbols, chunks, errors))], ["id", "keys"])

    return reps.select("id", "sig").mapInArrow(run, "id long, keys array<long>").select("id", F.posexplode("keys").alias("tag", "key"))


def fine_signatures(docs: DataFrame, ids: DataFrame, repeated: bool, width: int) -> DataFrame:
    """id and the longer signature of the documents with the given ids (doc_id)."""

    def sign_sets(ids: pa.Array, sets: list[np.ndarray], sign: Signer) -> pa.RecordBatch:
        rows = sign(sets).astype(np.uint8) if sets else np.zeros((0, FINE_POSITIONS), np.uint8)
        return pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "fine"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(FINE_POSITIONS, FINE_BITS)
        for whole in batches:
            for part in slices(whole, ROWS, SIZE):
                yield sign_sets(part.column("doc_id"), [shingles(t, width) for t in part.column("text").to_pylist()], sign)

    def of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(FINE_POSITIONS, FINE_BITS)
        for b in batches:
            yield sign_sets(b.column("doc_id"), [np.array(g, np.int64).view(np.uint64) for g in b.column("grams").to_pylist()], sign)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    if repeated:
        sets = full_sets(wanted, width).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
        return sets.mapInArrow(of_sets, "id long, fine binary")
    return wanted.mapInArrow(of_texts, "id long, fine binary")


def _compare(ids, comp, minor, tag, sig, fine, limit: int, positions: int, chunks: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of one block of a key whose first common key this is and whose fine signatures are close."""
    m, o = np.nonzero(minor)[0], np.arange(len(ids))
    found = []
    step = max(1, (1 << 24) // (len(ids) * FINE_POSITIONS))
    for at in range(0, len(m), step):
        rows = m[at : at + step]
        open_ = comp[rows, None] != comp[None, :]
        # two of the minority meet twice: once is enough
        open_ &= ~minor[None, :] | (ids[rows, None] > ids[None, :])
        i, j = np.nonzero(open_)
        if 4 * len(i) < open_.size:
            far = (fine[rows[i]] != fine[j]).sum(1)
        else:
            far = (fine[rows, None, :] != fine[None, o, :]).sum(2)[i, j]
        near = far <= limit
        found.append(np.stack([rows[i[near]], j[near]]))
    x, y = np.concatenate(found, 1) if found else np.zeros((2, 0), int)
    if not len(x):
        return x, y
    used = np.unique(np.concatenate([x, y]))
    keys = keys_of(np.frombuffer(b"".join(sig[k] for k in used), "<u2").reshape(-1, positions), chunks, errors)
    same = keys[np.searchsorted(used, x)] == keys[np.searchsorted(used, y)]
    first = same.argmax(1) == tag
    x, y = ids[x[first]], ids[y[first]]
    return np.maximum(x, y), np.minimum(x, y)


def cross_pairs(spark: SparkSession, docs: DataFrame, reps: DataFrame, placed: DataFrame, similarity: float, repeated: bool, positions: int, chunks: int, errors: int, width: int) -> DataFrame:
    """Distinct pairs (a, b) that share a key, are in different components and have close fine signatures.

    placed has key, tag, id and comp. The largest component of a key is its main one;
    all others are compared with it and among themselves, in blocks.
    """
    by_comp = placed.groupBy("key", "comp").count()
    mixed = by_comp.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("most"), F.sum("count").alias("n"), F.count("*").alias("c")).where("c > 1")
    mixed = mixed.select("key", F.col("most.comp").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = written(spark, placed.join(mixed, "key"), "rest")
    ids = written(spark, rest.select(F.col("id").alias("doc_id")).distinct(), "rest-ids")
    fine = written(spark, fine_signatures(docs, ids, repeated, width).join(reps.select("id", "sig"), "id"), "fine")
    block = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["key", "tag", "id", "comp", "main"]
    left = rest.where("comp <> main").select(*cols, F.lit(True).alias("is_left"), block(0).alias("p"), every.alias("q"))
    right = rest.select(*cols, F.lit(False).alias("is_left"), every.alias("p"), block(0).alias("q"))
    # a document on both sides of a block stands there once
    rows = left.union(right).groupBy("key", "p", "q", "tag", "id", "comp").agg(F.max("is_left").alias("minor"), F.min("is_left").alias("only"))
    rows = rows.join(fine, "id").select("key", "p", "q", "tag", "id", "comp", "minor", "sig", "fine")
    limit = allowed(FINE_POSITIONS, similarity, FINE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def of(t: pa.Table) -> pa.RecordBatch:
            place = np.stack([t.column(c).to_numpy() for c in ("key", "p", "q")], 1)
            edges = np.concatenate([[0], np.nonzero((place[1:] != place[:-1]).any(1))[0] + 1, [len(place)]])
            ids, comp, minor, tags = (t.column(c).to_numpy() for c in ("id", "comp", "minor", "tag"))
            sig, fine = t.column("sig").to_pylist(), np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE_POSITIONS)
            got = [_compare(ids[a:b], comp[a:b], minor[a:b], tags[a], sig[a:b], fine[a:b], limit, positions, chunks, errors) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
            x, y = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            # the last group may go on in the next batch
            place = np.stack([t.column(c).to_numpy() for c in ("key", "p", "q")], 1)
            ends = np.nonzero((place[1:] != place[:-1]).any(1))[0]
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield of(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield of(pa.Table.from_batches(held))

    out = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long")
    pairs = written(spark, out.distinct(), "cross")
    forget(rest, ids, fine)
    return pairs


def components(edges: DataFrame, spark: SparkSession, name: str = "components") -> DataFrame:
    """(id, comp) for every end of an edge (a, b): comp is the smallest id reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u")
        step = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step = written(spark, step, name)
        same = step.join(now, ["u", "v"], "left_anti").isEmpty() and step.count() == now.count()
        forget(now)
        now = step
        if same:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _confirm(spark: SparkSession, docs: DataFrame, sigs: DataFrame, pairs: DataFrame, percent: int, threshold: int, width: int, name: str) -> DataFrame:
    """Of pairs (a, b) those within the signature threshold and, on the full sets, the similarity."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sa", "sb"))
                keep = pa.array((x != y).sum(1) <= threshold)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    side = lambda c, s: sigs.select(F.col("id").alias(c), F.col("sig").alias(s), F.col("n_shingles").alias(f"n{s}"))
    # sets whose sizes alone rule the similarity out need no look
    sized = F.least("nsa", "nsb") * 100 >= F.greatest("nsa", "nsb") * percent
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").where(sized).select("a", "b", "sa", "sb")
    close = written(spark, both.mapInArrow(near, "a long, b long"), f"{name}-close")
    ids = written(spark, close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct(), f"{name}-ids")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    sets = full_sets(wanted, width).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    sets = written(spark, sets, f"{name}-sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    linked = close.join(left, "a").join(right, "b").select("a", "b", shared.alias("i"), (F.size("ga") + F.size("gb")).alias("s"))
    links = written(spark, linked.where((F.col("i") * 100) >= (F.col("s") - F.col("i")) * percent).select("a", "b"), f"{name}-links")
    forget(close, ids, sets)
    return links


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    percent: int = 80,
    width: int = WIDTH,
    positions: int = POSITIONS,
    errors: int = ERRORS,
    bits: int = BITS,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: components of the links with at least ``percent`` per cent similarity."""
    threshold = allowed(positions, percent / 100, bits)
    chunks = -(-(threshold + 1) // (errors + 1))  # so many that one of them has at most ``errors`` of the differences
    known = docs.where("doc_id IS NOT NULL")
    sigs = written(spark, signatures(known, positions, bits, width), "signatures")
    again = sigs.groupBy("doc_id").count().where("count > 1")
    repeated = not again.isEmpty()
    if repeated:  # repeated ids: join their texts' sets by signing the joined set
        sigs = written(spark, _joined(known, sigs, again, positions, bits, width), "signatures")
    classes = sigs.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    reps = written(spark, classes.select("id", "sig", "n_shingles", "fp"), "classes")

    keys = index_keys(reps, positions, chunks, errors, bits)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(spark, keys.join(shared, "key"), "members")
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = members.select("key", "id").join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("o"))).alias("m"))
    hubs = hubs.select("key", (-F.col("m.o")).alias("hub"))
    spokes = members.select("key", "id").join(hubs, "key").where("id <> hub")
    stars = written(spark, spokes.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct(), "pairs")
    links = _confirm(spark, known, reps, stars, percent, threshold, width, "stars")
    comps = written(spark, components(links, spark), "comps")

    # what the keys still hold in different components
    placed = members.select("key", "tag", "id").join(comps, "id", "left").select("key", "tag", "id", F.coalesce("comp", "id").alias("comp"))
    cross = cross_pairs(spark, known, reps, placed, percent / 100, repeated, positions, chunks, errors, width)
    new = cross.join(stars, ["a", "b"], "left_anti")  # those are settled
    more = _confirm(spark, known, reps, new, percent, threshold, width, "cross")
    final = written(spark, components(links.union(more), spark), "comps")
    forget(members, stars, links, comps, cross, more)

    # a class of equal sets takes the component of its representative
    of_class = reps.join(final, "id", "left").select("fp", F.coalesce("comp", "id").alias("comp"))
    placed = sigs.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
    alone = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    lone = signatures(alone, positions, bits, width).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")).unionByName(lone)


def _joined(docs: DataFrame, sigs: DataFrame, again: DataFrame, positions: int, bits: int, width: int) -> DataFrame:
    """Signatures with one row for each doc_id; a repeated id gets the union of its rows' sets."""

    def resign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(positions, bits)
        for b in batches:
            sets = [np.unique(np.array(g, np.int64).view(np.uint64)) for g in b.column("grams").to_pylist()]
            sig = [sign([s])[0].astype("<u2").tobytes() if len(s) else None for s in sets]
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    ids = again.select("doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").distinct()
    sets = full_sets(texts, width).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"))
    return sigs.join(ids, "doc_id", "left_anti").unionByName(sets.mapInArrow(resign, "doc_id long, n_shingles long, fp binary, sig binary"))


def op8_near_dup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(spark, docs, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT documents.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id, documents.doc_id = min(r.c) AS kept
FROM documents JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY documents.doc_id
"""
