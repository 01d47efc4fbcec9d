"""Document fingerprints with DataFrame functions only: a threshold-scaled sketch of word shingles.

A text's shingles are its runs of ``n`` words. Its sketch keeps every shingle hash
below a fixed fraction, 1 / ``scale``, of all hash values. What two sketches share
below that threshold estimates how much the texts share, also where one is far
longer than the other, and the union of sketches is the sketch of the union.

So that short texts have a sketch too, one with fewer than ``floor`` hashes below
the threshold keeps its ``floor`` smallest. Up to its limit a sketch is complete:
a short text's limit is its largest hash, or none if it holds all, and else the
threshold. Two sketches are compared below the smaller of their limits, where the
hashes of both are a fair sample, so sketches that were cut differently compare.

The next document is found without a global sort: quantiles of the ids cut the
table into slices, in which a window looks one row ahead; the first row of each
slice is dealt to the slice before it as well.

Defined results. Words are runs of other characters than ASCII white space, A-Z
lower-cased. A text of fewer than ``n`` words, but not none, has one shingle; null,
empty and blank texts have an empty sketch, whose likeness is 1 to another empty
one and 0 to all others. Rows that repeat a doc_id stand in the order of their
texts; null doc_ids stand last. One row alone is its own next. An empty table has
no rows. Other columns pass through, but for those with the names of new ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwise.llm.common import ascii_lower, fresh, others

#: Words of a shingle; the kept fraction is 1 / SCALE; hashes of a short text's sketch.
WORDS, SCALE, FLOOR = 5, 16, 32
GAP = r"[\x20\x09-\x0D]+"
NONE = (1 << 63) - 1


def threshold(scale: int = SCALE) -> int:
    """The hash value below which the fraction 1 / scale of all signed 64-bit hashes lies."""
    return -(1 << 63) + (1 << 64) // scale


def add_sketch(df: DataFrame, text: str = "text", name: str = "sketch", n: int = WORDS, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """The rows with a sketch (sorted array of long) of a text column added."""
    df = df.select(*others(df.columns, name)) if text.lower() != name.lower() else df
    words, hashes, low = fresh([*df.columns, name], "words", "hashes", "low")
    split = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP), "")
    w = F.col(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    all_hashes = F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    # each step is a column of its own, as an expression inside a function is computed for every element
    df = df.withColumn(words, F.transform(split, lambda x: F.xxhash64(x))).withColumn(hashes, all_hashes).drop(words)
    df = df.withColumn(low, F.array_distinct(F.filter(hashes, lambda h: h < F.lit(threshold(scale)))))
    kept = F.when(F.size(low) >= floor, F.sort_array(low)).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, floor))
    return df.withColumn(name, kept).drop(hashes, low)


def limit_of(sketch: Column, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """The value below which a sketch has every hash of its text."""
    return F.when(F.size(sketch) < floor, F.lit(NONE)).otherwise(F.greatest(F.lit(threshold(scale)), F.element_at(sketch, -1) + 1))


def add_likeness(df: DataFrame, a: str, b: str, near: str, held: str, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """The rows with two estimates added: shared shingles of all shingles (near), and of those of ``a`` (held)."""
    limit, x, y, both = fresh([*df.columns, near, held], "limit", "x", "y", "both")
    df = df.withColumn(limit, F.least(limit_of(F.col(a), scale, floor), limit_of(F.col(b), scale, floor)))
    below = lambda c: F.filter(F.col(c), lambda h: h < F.col(limit))
    df = df.withColumn(x, below(a)).withColumn(y, below(b))
    df = df.withColumn(both, F.size(F.array_intersect(x, y))).withColumns({x: F.size(x), y: F.size(y)})
    total = F.col(x) + F.col(y) - F.col(both)
    df = df.withColumn(near, F.when(total == 0, F.lit(1.0)).otherwise(F.col(both) / total))
    return df.withColumn(held, F.when(total == 0, F.lit(1.0)).when(F.col(x) == 0, F.lit(0.0)).otherwise(F.col(both) / F.col(x))).drop(limit, x, y, both)


def fingerprint_of(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(df: DataFrame, key: str, sketch: str = "sketch", scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """The sketch of each key's texts together, a row for each hash: key, limit, h.

    Below the smallest limit of its texts a key's hashes are complete. They stay
    rows, so that a key with most of the table has no large group.
    """
    limits = df.groupBy(key).agg(F.min(limit_of(F.col(sketch), scale, floor)).alias("limit"))
    each = df.select(key, F.explode(sketch).alias("h")).distinct()
    same = each[key].eqNullSafe(limits[key])
    return each.join(limits, same).where(F.col("h") < F.col("limit")).select(each[key], "limit", "h")


def containment(merged_rows: DataFrame, key: str, a, b) -> float:
    """The estimated share of the shingles of key ``a`` that key ``b`` has, from the rows of :func:`merged`."""
    own = merged_rows.where((F.col(key) == F.lit(a)) | (F.col(key) == F.lit(b)))
    limit = own.agg(F.min("limit")).first()[0]
    if limit is None:
        return 0.0
    of = own.where(F.col("h") < limit).groupBy("h").agg(F.max(F.col(key) == F.lit(a)).alias("a"), F.max(F.col(key) == F.lit(b)).alias("b"))
    n, both = of.agg(F.count(F.when(F.col("a"), 1)), F.count(F.when(F.col("a") & F.col("b"), 1))).first()
    return both / n if n else 0.0


def _slice_of(key: Column, bounds: list) -> Column:
    """How many of the bounds, largest first, are above the key; all for null. Two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    every, coarse = (F.array(*[F.lit(b) for b in x]) for x in (bounds, bounds[::step]))
    above = lambda x: F.size(F.filter(x, lambda b: b > key))
    first = above(coarse)
    fine = F.when(first == 0, 0).otherwise((first - 1) * step + above(F.slice(every, (first - 1) * step + 1, step)))
    return F.when(key.isNull(), len(bounds)).otherwise(fine)


def add_next(df: DataFrame, key: str, order: str, columns: dict[str, str], slices: int | None = None) -> DataFrame:
    """The rows with columns of the next row by descending numeric key (then ``order``) added; the first is next to the last.

    columns: new name by the column that it is taken from. The driver holds two keys
    for each slice; slices are four for each shuffle partition unless given.
    """
    slices = slices or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = df.select(F.percentile_approx(key, [k / slices for k in range(1, slices)], 100 * slices)).first()[0] if slices > 1 else None
    bounds = sorted(set(marks or []), reverse=True)
    at, guest, part = fresh([*df.columns, *columns.values()], "slice", "guest", "part")
    heads = {r[at]: r["head"] for r in df.select(_slice_of(F.col(key), bounds).alias(at), key).groupBy(at).agg(F.max(key).alias("head")).collect()}
    order_of = sorted(heads)
    if not order_of:
        return df.withColumns({new: F.col(c) for c, new in columns.items()})
    before = dict(zip(order_of, [order_of[-1], *order_of[:-1]], strict=True))
    first = F.array(*[F.lit(heads.get(k)) for k in range(len(bounds) + 1)])
    to = F.array(*[F.lit(before.get(k, 0)) for k in range(len(bounds) + 1)])
    placed = df.withColumn(at, _slice_of(F.col(key), bounds))
    own = F.struct(F.col(at).alias(at), F.lit(False).alias(guest))
    twice = F.array(own, F.struct(F.get(to, F.col(at)).alias(at), F.lit(True).alias(guest)))
    dealt = placed.withColumn(part, F.when(F.col(key).eqNullSafe(F.get(first, F.col(at))), twice).otherwise(F.array(own))).drop(at)
    dealt = dealt.select("*", F.inline(part)).drop(part)
    ahead = Window.partitionBy(at).orderBy(guest, F.desc_nulls_last(key), order)
    return dealt.withColumns({new: F.lead(c).over(ahead) for c, new in columns.items()}).where(~F.col(guest)).drop(at, guest)


def fingerprints(docs: DataFrame, n: int = WORDS, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """The documents (doc_id, text) with sketches of their texts and of their edited texts, and with their likeness to these and to the next document.

    Edited: the last half of the characters give way to the first as many of the
    next document. Adds edited, sketch, edited_sketch, next_sketch, near_edited,
    held_edited, near_next and held_next.
    """
    added = ["edited", "sketch", "edited_sketch", "next_sketch", "near_edited", "held_edited", "near_next", "held_next"]
    docs = docs.select(*others(docs.columns, *added))
    own, after = fresh([*docs.columns, *added], "own", "after")
    base = docs.withColumn(own, F.coalesce("text", F.lit("")))
    base = add_sketch(base, own, "sketch", n, scale, floor)
    base = add_next(base, "doc_id", own, {own: after, "sketch": "next_sketch"})
    half = F.floor(F.char_length(own) / 2).cast("int")
    base = base.withColumn("edited", F.concat(F.substr(F.col(own), F.lit(1), F.char_length(own) - half), F.substr(F.col(after), F.lit(1), half))).drop(own, after)
    base = add_sketch(base, "edited", "edited_sketch", n, scale, floor)
    base = add_likeness(base, "sketch", "edited_sketch", "near_edited", "held_edited", scale, floor)
    return add_likeness(base, "sketch", "next_sketch", "near_next", "held_next", scale, floor)


def op13_fingerprint(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs).select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_of(F.col("sketch")).alias("fingerprint"),
        fingerprint_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "held_edited",
        "held_next",
    )
