"""Benchmark decontamination with DataFrame functions only.

The normalised n-grams of the test items form a hash set that is broadcast
(behind a check of its size). One scan of the documents hashes the windows of all
lengths that the set has, probes it, and compares the words of a hit before it
counts, so equal hashes of other words do no harm. A set too large to broadcast
is joined by shuffle on the hashes alone; the words of the few candidates are
then compared with those of their documents.

Defined results. Null texts and texts without words have no words and no hits.
An item with fewer than ``n`` words, but not none, is one window. Items with a
null id count as hits but not as items. Rows that repeat a doc_id, and null
doc_ids, are judged row by row. Very long texts are scanned whole. An empty
benchmark leaves all documents clean. Other columns are passed through
untouched by :func:`decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwise.llm.common import ascii_lower, broadcast_if_small, row_key, written

#: Between words: ASCII that is neither a letter nor a digit.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A run of word characters of either case, or a run of anything else.
PIECE = r"([A-Za-z0-9[^\x00-\x7F]]+|[\x00-\x7F&&[^A-Za-z0-9]]+)"
#: Windows up to which the set is broadcast; about 200 bytes each.
SET_LIMIT = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _window_hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + F.lit(k)) for k in range(length)], F.lit(length))


def windows_of(items: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows (n_words, win, items) of the test items."""
    each = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = each.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1))), lambda i: F.slice("w", i, n))).alias("win"),
    )
    return cut.groupBy("win").agg(F.collect_set("item_id").alias("items")).withColumn("n_words", F.size("win"))


def find_hits(docs: DataFrame, items: DataFrame, n: int = 10, set_limit: int = SET_LIMIT) -> DataFrame:
    """One row for each occurrence of a window: doc_id, rk, pos (from 0), n_words, items."""
    windows = windows_of(items, n)
    sizes = {r["n_words"]: r["count"] for r in windows.groupBy("n_words").count().collect()}  # at most n rows
    lengths = sorted(sizes) or [n]
    word_hash = F.transform("win", lambda w: F.xxhash64(w))
    zero = F.lit(0)
    by_length = F.coalesce(*[F.when(F.col("n_words") == k, _window_hash(F.col("wh"), zero, k)) for k in lengths])
    probe = windows.withColumn("wh", word_hash).select(by_length.alias("h"), "n_words", "win", "items")

    split = docs.select("doc_id", row_key(F.col("text")).alias("rk"), words_of(F.col("text")).alias("w"))
    hashed = split.select("doc_id", "rk", "w", F.transform("w", lambda w: F.xxhash64(w)).alias("wh"))
    none = F.array().cast("array<bigint>")

    def windows(k: int) -> Column:
        return F.when(F.size("wh") >= k, F.transform(F.sequence(zero, F.size("wh") - k), lambda i: _window_hash(F.col("wh"), i, k))).otherwise(none)

    # the windows of all lengths in one array: those of a length begin where the shorter ones end
    each = F.concat(*[windows(k) for k in lengths])
    count = lambda k: F.greatest(zero, F.size("w") - (k - 1))
    begin = F.coalesce(*[F.when(F.col("n_words") == k, sum((count(j) for j in lengths if j < k), zero)) for k in lengths])
    # outer: a plain explode would make Spark compute the hashes twice, once to filter empty arrays
    scan = hashed.select("doc_id", "rk", "w", each.alias("hs")).select("doc_id", "rk", "w", F.posexplode_outer("hs").alias("at", "h"))
    pos = (F.col("at") - begin).alias("pos")
    same = (pos >= 0) & (F.slice("w", pos + 1, F.col("n_words")) == F.col("win"))
    if sum(sizes.values()) <= set_limit:
        found = scan.join(F.broadcast(probe), "h")
    else:
        near = scan.select("doc_id", "rk", "at", "h").join(probe, "h").withColumnsRenamed({"doc_id": "c_id", "rk": "c_rk"})
        near = written(docs.sparkSession, near, "candidates")
        found = split.dropDuplicates(["doc_id", "rk"]).join(near, split.doc_id.eqNullSafe(F.col("c_id")) & (split.rk == F.col("c_rk")))
    return found.where(same).select("doc_id", "rk", pos, "n_words", "items")


def spans_of(hits: DataFrame) -> DataFrame:
    """Per document row with hits: the hit word positions and the items."""
    return (
        hits.groupBy("doc_id", "rk")
        .agg(F.collect_set(F.struct("pos", "n_words")).alias("at"), F.collect_set("items").alias("items"))
        .select(
            "doc_id",
            "rk",
            F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s.pos, s.pos + s.n_words - 1))))).alias("hit_words"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )


def report(docs: DataFrame, items: DataFrame, n: int = 10, set_limit: int = SET_LIMIT) -> DataFrame:
    """One row per document row: doc_id, rk, n_words, hit_words (positions) and items."""
    spans = spans_of(find_hits(docs, items, n, set_limit)).withColumnsRenamed({"doc_id": "s_id", "rk": "s_rk"})
    base = docs.select("doc_id", row_key(F.col("text")).alias("rk"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none_int, none_str = F.array().cast("array<int>"), F.array().cast("array<string>")
    return base.join(spans, base.doc_id.eqNullSafe(spans.s_id) & (base.rk == spans.s_rk), "left").select(
        "doc_id", "rk", "n_words", F.coalesce("hit_words", none_int).alias("hit_words"), F.coalesce("items", none_str).alias("items")
    )


def without_spans(text: Column, hit_words: Column) -> Column:
    """The text without its hit words; what stood between two removed words goes with them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))
    # words and gaps alternate: piece i is word i // 2 if the text starts with a word, else (i - 1) // 2
    first = F.when(F.rlike(text, F.lit(r"^[A-Za-z0-9[^\x00-\x7F]]")), 0).otherwise(1)

    words = F.transform(hit_words, lambda x: 2 * x + first)
    between = F.transform(F.filter(hit_words, lambda x, i: F.coalesce(F.get(hit_words, i + 1) == x + 1, F.lit(False))), lambda x: 2 * x + 1 + first)
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.concat(words, between))
    return F.when(F.size(pieces) == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), ""))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", set_limit: int = SET_LIMIT) -> DataFrame:
    """Documents without those that hold a window (``remove="documents"``), or without the hit spans (``"spans"``)."""
    spans = written(docs.sparkSession, spans_of(find_hits(docs, items, n, set_limit)).select(F.col("doc_id").alias("s_id"), F.col("rk").alias("s_rk"), "hit_words"), "spans")
    if remove == "documents":
        spans = broadcast_if_small(spans.select("s_id", "s_rk"))
    same = docs.doc_id.eqNullSafe(spans.s_id) & (row_key(docs.text) == spans.s_rk)
    if remove == "documents":
        return docs.join(spans, same, "left_anti")
    text = F.when(spans.hit_words.isNull(), docs.text).otherwise(without_spans(docs.text, spans.hit_words))
    return docs.join(spans, same, "left").select(*[text.alias(c) if c.lower() == "text" else docs[c] for c in docs.columns])


def op1_decontaminate(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return report(docs, items).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win FROM bi),
ls AS (SELECT DISTINCT len(win) AS n FROM bw),
dp AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ls WHERE len(w) >= n),
h AS (SELECT dp.r, dp.i, dp.n, bw.item_id FROM dp JOIN bw ON bw.win = list_slice(dp.w, dp.i, dp.i + dp.n - 1)),
p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
