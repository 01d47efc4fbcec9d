"""Threshold-scaled sketches against plain Python over the same hashes, and estimates against full sets."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwise.llm import fingerprint as fp

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _chain(values, kind=None):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def shingles(text, n=fp.WORDS):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def sketch(text, scale=fp.SCALE, floor=fp.FLOOR):
    hashes = sorted({_chain([_chain([w]) for w in s]) for s in shingles(text)})
    low = [h for h in hashes if h < fp.threshold(scale)]
    return low if len(low) >= floor else hashes[:floor]


def likeness(a, b, scale=fp.SCALE, floor=fp.FLOOR):
    limit = min(fp.NONE if len(s) < floor else max(fp.threshold(scale), s[-1] + 1) for s in (a, b))
    x, y = {h for h in a if h < limit}, {h for h in b if h < limit}
    return (len(x & y) / len(x | y), len(x & y) / len(x) if x else 0.0) if x | y else (1.0, 1.0)


def brute(rows):
    """doc_id, n_chars, sha of the edited text, both sketches and the four estimates of each row."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        s, e, x = sketch(t), sketch(edited), sketch(after)
        hex_ = lambda s: "".join(f"{h % (1 << 64):016x}" for h in s)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hex_(s), hex_(e), *likeness(s, e), *likeness(s, x)))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "held_edited", "near_next", "held_next"]
ODD = [
    (7, "One two three four five six seven"),
    (5, None),
    (4, ""),
    (3, " \t\n"),
    (2, "four words are here"),
    (2, "another text of the same id"),
    (2, "another text of the same id"),
    (9, "é漢😀 " * 31 + "end"),
    (8, "w " * 3000 + " ".join(f"u{i}" for i in range(9000))),
    (11, " ".join(f"u{i}" for i in range(8000))),
    (None, "no id at all here now"),
    (None, "also none"),
]


def own_hash(spark):
    """Whether plain Python hashes as the session does."""
    r = spark.sql("SELECT xxhash64('a', 'b') AS s, xxhash64(1L, -2L) AS n").first()
    return r["s"] == _chain(["a", "b"]) and r["n"] == _chain([1, -2])


def rows_of(df):
    df = df.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fp.fingerprint_of(F.col("sketch")).alias("fingerprint"),
        fp.fingerprint_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        *COLS[5:],
    )
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)




def test_odd_rows_match_brute_force(spark):
    assert own_hash(spark)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in ODD], "doc_id long, text string, slice int, Sketch string")
    got, want = rows_of(fp.fingerprints(docs)), brute(ODD)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    full = [r for r in want if r[0] in (7, 8, 9, 11)]
    assert [r for r in got if r[0] in (7, 8, 9, 11)] == full
    blank = [r for r in got if r[0] in (3, 4, 5)]
    assert all(r[3] == "" for r in blank)
    twice = [r for r in got if r[0] == 2]
    assert len({r[3] for r in twice}) == 2


@pytest.mark.parametrize("slices", [1, 2, 7, 500])
def test_next_row_whatever_the_slices(spark, slices):
    rng = np.random.default_rng(slices)
    ids = [int(x) for x in rng.integers(-(10**12), 10**12, 200)] + [5] * 40 + [None] * 9
    rows = [(d, f"t{k:04d}") for k, d in enumerate(ids)]
    got = fp.add_next(spark.createDataFrame(rows, "d long, t string").repartition(5), "d", "t", {"t": "after"}, slices)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert {r["t"]: r["after"] for r in got.collect()} == {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_empty_table_and_one_row(spark):
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = fp.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert r["edited"] == "a b c a b c" and r["near_next"] == 1.0


def test_query_matches_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in fp.op13_fingerprint(spark, SF).collect()}
    short = {d for k, (d, t) in enumerate(rows) if len(WORD.findall(t or "")) < 10}
    for want in brute(rows):
        d = want[0]
        assert got[d][:3] == want[:3]
        if d not in short and d - 1 not in short and d + 1 not in short:
            assert got[d] == pytest.approx(want)


def test_estimates_are_near_full_sets(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) > 3000").fetchall()
    text = dict(rows)
    off = []
    for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        a, b = shingles(text[r["doc_id"]]), shingles(r["edited"])
        off.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.07


def test_merged_sketches_estimate_containment(spark):
    """A short source that a long one holds by half, from rows of hashes alone."""
    long = [" ".join(f"a{d}_{i}" for i in range(3000)) for d in range(8)]
    rows = [("long", t) for t in long] + [("short", long[0]), ("short", " ".join(f"b{i}" for i in range(3000))), (None, "x y z")]
    m = fp.merged(fp.add_sketch(spark.createDataFrame(rows, "source string, text string")), "source")
    assert fp.containment(m, "source", "short", "long") == pytest.approx(0.5, abs=0.1)
    assert fp.containment(m, "source", "long", "short") == pytest.approx(1 / 8, abs=0.05)
    whole = fp.add_sketch(spark.createDataFrame([(" ".join(long),)], "text string")).select(F.size(F.filter("sketch", lambda h: h < fp.threshold()))).first()[0]
    assert abs(m.where("source = 'long'").count() - whole) < 40  # but for shingles over the joints
