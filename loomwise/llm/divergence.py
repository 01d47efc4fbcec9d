"""How far the sources of a language are from each other, term by term, in exact integers.

Terms are counted where the text is read. Each kept term of a language is one row
with a vector of its counts by source. Higher-order functions turn the vector into
shares, and a row for each source that has the term holds what the term adds to
its divergence from each other source, and to that of a source without the term
from it; an aggregation that begins where the rows are sums them. What the terms
add that neither source has is the same for each, and is added at the end, so the
work follows the occurrences and not terms times pairs.

A share is p = 1 + floor(10^9 (count + smoothing) / (N + smoothing V)) and the
divergence of p from q adds up floor((p - q)^2 / q) over the kept terms. Counts up
to 9 * 10^15 stay exact, as the division is taken in steps of a thousand where the
product would leave a long; sums stay exact up to 10^9 kept terms.

Defined results. Null texts, languages and sources are empty strings. A source
without any kept term has smoothed shares; in a language without kept terms all
divergences are 0. Rows that repeat a doc_id count as documents each. Ranks go by
value, then by the item's UTF-8 bytes. An empty table has no rows. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwise.llm.common import broadcast_if_small, slices, written

ONE = 1_000_000_000


#: Entries of a task's counters before it hands them on.
HELD = 400_000
#: Sources that an aggregation has a column for, and that a row of pair sums has.
WIDE, BLOCK = 128, 32
#: Separators become spaces, A-Z their lower case; bytes beyond ASCII belong to terms.
SIGNS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(SIGNS).split() if text else []


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences) and docs: partial counts, several rows for a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (c, docs) in seen.items():
                n = len(c)
                if n:
                    term = pa.array(list(c), pa.binary()).cast(pa.string())
                    cols = [pa.array([lang]).take(pa.array(np.zeros(n, np.int32))), pa.array([source]).take(pa.array(np.zeros(n, np.int32))), term, pa.array(list(c.values()), pa.int64()), pa.array([docs[w] for w in c], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "c", "docs"])
            seen.clear()

        for whole in batches:
            for b in slices(whole):
                for lang, source, text in zip(*(b.column(k).to_pylist() for k in ("lang", "source", "text")), strict=True):
                    c, held = seen.setdefault((lang or "", source or ""), (Counter(), Counter()))
                    words = terms_of(text)
                    c.update(words)
                    held.update(set(words))
                if sum(len(c) for c, _ in seen.values()) > HELD:
                    yield from out()
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, c long, docs long")


def _share(x: str, total: str) -> str:
    """SQL for 1 + floor(ONE * x / total) of longs, x at most total."""
    one, two = f"({x}) * 1000", f"((({x}) * 1000) % ({total})) * 1000"
    steps = f"1000000 * ({one} div ({total})) + 1000 * ({two} div ({total})) + (({two}) % ({total})) * 1000 div ({total})"
    return f"1L + if(({x}) <= 9000000000L, {ONE}L * ({x}) div ({total}), {steps})"


def _apart(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _groups(docs: DataFrame) -> DataFrame:
    """lang, source and the source's place k in the vectors of its language."""
    own = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    return own.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def term_vectors(docs: DataFrame, groups: DataFrame, least: int = 3) -> DataFrame:
    """lang, term, total and counts (by the places k of the sources) of terms in at least ``least`` documents of a language."""
    most = groups.agg(F.max("k")).first()[0]
    size = groups.groupBy("lang").agg(F.count("*").cast("int").alias("size"))
    # one shuffle by language and term serves both aggregations; a task hands on a term once a source
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    placed = counts.join(broadcast_if_small(groups), ["lang", "source"]).groupBy("lang", "term")
    sums = [F.sum("docs").alias("docs"), F.sum("c").alias("total")]
    if most is None or most < WIDE:
        wide = placed.agg(*sums, F.array(*[F.coalesce(F.sum(F.when(F.col("k") == i, F.col("c"))), F.lit(0)) for i in range((most or 0) + 1)]).alias("m"))
        counts = F.slice("m", F.lit(1), F.col("size"))
    else:
        wide = placed.agg(*sums, F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
        counts = F.expr("transform(sequence(0, size - 1), i -> coalesce(try_element_at(m, i), 0L))")
    return wide.where(F.col("docs") >= least).join(broadcast_if_small(size), "lang").select("lang", "term", "total", counts.alias("counts"))


def _totals(vectors: DataFrame, smoothing: int) -> DataFrame:
    """By language: v (kept terms times the smoothing), n_all, and ns, the counts of each source."""
    by = vectors.select("lang", F.posexplode("counts").alias("k", "c")).groupBy("lang", "k").agg(F.sum("c").alias("n"), F.count("*").alias("terms"))
    return by.groupBy("lang").agg(
        F.max("terms").alias("terms"),
        (F.max("terms") * smoothing).alias("v"),
        F.sum("n").alias("n_all"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: s["n"]).alias("ns"),
    )


def pair_divergences(vectors: DataFrame, totals: DataFrame, groups: DataFrame, smoothing: int = 1) -> DataFrame:
    """lang, source, item (each other source of the language) and value, the divergence of the source from it."""
    most = groups.agg(F.max("k")).first()[0] or 0
    width = min(most + 1, BLOCK)
    shares = vectors.join(totals, "lang").select(
        "lang",
        "counts",
        F.expr(f"transform(counts, (c, i) -> {_share(f'c + {smoothing}L', 'ns[i] + v')})").alias("p"),
        F.expr("filter(sequence(0, size(counts) - 1), i -> counts[i] > 0)").alias("has"),
    )
    # a row for each source that has the term, and for each block of the others
    each = shares.select("lang", "counts", "p", F.explode("has").alias("k")).select("lang", "counts", "p", "k", F.expr("p[k]").alias("own"), F.explode(F.expr(f"sequence(0, (size(p) - 1) div {width})")).alias("b"))
    of = [f"b * {width} + {t}" for t in range(width)]
    each = each.select("lang", "k", "b", "own", *[F.expr(f"get(p, {x})").alias(f"p{t}") for t, x in enumerate(of)], *[F.expr(f"get(counts, {x}) = 0").alias(f"z{t}") for t, x in enumerate(of)])
    sums = [F.expr(f"sum({_apart('own', f'p{t}')})").alias(f"x{t}") for t in range(width)]  # it has the term, whatever the other
    sums += [F.expr(f"sum(if(z{t}, {_apart(f'p{t}', 'own')}, 0L))").alias(f"y{t}") for t in range(width)]  # the other hasn't: the other's divergence from it
    sums += [F.count_if(F.col(f"z{t}")).alias(f"n{t}") for t in range(width)]
    by = each.groupBy("lang", "k", "b").agg(*sums, F.count("*").alias("has"))
    entries = F.array(*[F.struct((F.col("b") * width + t).cast("int").alias("j"), F.col(f"x{t}").alias("x"), F.col(f"y{t}").alias("y"), F.col(f"n{t}").alias("n")) for t in range(width)])
    by = written(vectors.sparkSession, by.select("lang", "k", "has", F.inline(entries)), "pairs")
    ahead = by.select("lang", "k", "j", "x", "has")
    back = by.select("lang", F.col("j").alias("k"), F.col("k").alias("j"), "y", "n")
    named = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("k").alias("j")), "lang").where("k != j")
    none_k, none_j = (_share(f"{smoothing}L", f"ns[{x}] + v") for x in ("k", "j"))
    unseen = F.expr(f"(terms - coalesce(has, 0L) - coalesce(n, 0L)) * ({_apart(none_k, none_j)})")
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_of = named.join(ahead, ["lang", "k", "j"], "left").join(back, ["lang", "k", "j"], "left").join(totals, "lang", "left")
    return all_of.select("lang", "source", "item", F.when(F.col("terms").isNull(), 0).otherwise(zero("x") + zero("y") + unseen).cast("long").alias("value"))


def leading_terms(vectors: DataFrame, totals: DataFrame, groups: DataFrame, smoothing: int = 1) -> DataFrame:
    """lang, source, item and value of the terms that a source has a larger share of than its language."""
    q = _share(f"total + {smoothing}L", "n_all + v")
    each = vectors.join(totals, "lang").select("lang", "term", F.expr(q).alias("q"), "ns", "v", F.posexplode("counts").alias("k", "c")).where("c > 0")
    each = each.select("lang", "term", "k", "q", F.expr(_share(f"c + {smoothing}L", "ns[k] + v")).alias("p")).where("p > q")
    return each.join(groups, ["lang", "k"]).select("lang", "source", F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))


def audit(docs: DataFrame, least: int = 3, top: int = 200, smoothing: int = 1) -> DataFrame:
    """lang, source, part, item, value and rank: all of part ``pair``, and the ``top`` first of part ``term``."""
    spark = docs.sparkSession
    groups = written(spark, _groups(docs), "groups")
    vectors = written(spark, term_vectors(docs, groups, least), "vectors")
    totals = broadcast_if_small(written(spark, _totals(vectors, smoothing), "totals"), 10_000)
    groups = broadcast_if_small(groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pair_divergences(vectors, totals, groups, smoothing).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    # Spark cuts each task's rows to the first ``top`` of a source before it shuffles them
    terms = leading_terms(vectors, totals, groups, smoothing).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_source_divergence(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
n_all AS (SELECT lang, sum(c) AS n FROM c GROUP BY lang),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
q AS (
  SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.c) + 1)) // (any_value(n_all.n) + any_value(v.v)) AS q
  FROM c JOIN n_all USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (
  SELECT p.lang, p.source, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
