"""Language ID, BPE, LM scoring and near-duplicates on small fixtures."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwise.llm import bpe, langid, lm_score, near_dup

TEXTS = ["", None, " ", "a", "The quick brown fox!", "don't 'S'T it'LL", "ΑΣ ΟΔΟΣ Σ", "<|endoftext|>x <|startoftext|>", "aaaa" * 300, "12 3½ ²", "日本語 text", "👍🏽 é é", "\x1ca\x1fb c\x85d", "THE the The " * 50, "a\n\tb"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    mine, theirs = bpe.WordBpe(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("abcdefghinrst thein'<|>.,!?éüñİΣ123\n") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want, t
        assert mine.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_documents(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate([*TEXTS, TEXTS[4]])], "doc_id long, text string, lang string, ids string, n int")
    rows = bpe.encode_documents(docs).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS) + 1 and rows[0]["ids"] == [] and rows[1]["decoded"] == "" and rows[4]["ids"] == rows[-1]["ids"]
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def sum_of_segmentations(p, word, probs):
    """By recursion over all cuts, with the vocabulary as plain strings."""
    names = names_of(p)
    s = langid.START + word

    def rest(i):
        if i == len(s):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(s) + 1):
            k = names.get(s[i:j], p.n - 1 if j == i + 1 else None)
            if k is not None:
                total += probs[k] * rest(j)
        return total

    return rest(0)


def names_of(p):
    import re

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    body = re.compile(rf"{langid.START}?[^\W\d_]+|{langid.START}")
    return {x: k for k, x in enumerate(x for x in map(sp.id_to_piece, range(sp.get_piece_size())) if body.fullmatch(x) and x == x.lower())}


def test_forward_sums_all_segmentations():
    p = langid._load(None, "piece_bpe_32k.model")
    probs = np.random.default_rng(1).random((p.n, 1))
    probs /= probs.sum()
    for w in ["a", "the", "nation", "über", "qz日"]:
        want = math.log(sum_of_segmentations(p, w, probs[:, 0]))
        assert p.log_forward([w], probs)[0, 0] == pytest.approx(want)
        assert p._log_forward_long(w, probs)[0] == pytest.approx(want)
    long = "ab" * 300
    assert np.isfinite(p.log_forward([long], probs)).all()


def test_expected_counts_conserve_characters():
    p = langid._load(None, "piece_bpe_32k.model")
    probs = np.full((p.n, 1), 1 / p.n)
    used = p.expected(["nation", "of"], np.array([[2.0], [1.0]]), probs)
    size = np.ones(p.n)
    for name, k in names_of(p).items():
        size[k] = len(name)
    assert (used[:, 0] * size).sum() == pytest.approx(2 * 7 + 3)


def test_language_id(spark):
    vocab = {"xx": ["nation", "station", "the", "thing"], "yy": ["zeitung", "und", "keit", "schein"]}
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(vocab["xx" if k % 2 else "yy"], k=20)), "xx" if k % 2 else "yy") for k in range(60)]
    model = langid.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "the station", "s"), (2, "UND Zeitung", "s"), (3, None, "s"), (4, "", "s"), (5, "123 !!", "s"), (None, "und " * 5000, "s"), (6, "x" * 5000, "s"), (1, "the station", "s")], "doc_id long, text string, score0 string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in model.predict(test).collect()}
    assert model.predict(test).count() == 8
    assert got[1][0] == "xx" and got[2][0] == "yy" and got[None][0] == "yy" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.train(spark, test.limit(0).withColumn("lang", test.score0))
    assert {r["lang_pred"] for r in empty.predict(test).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = langid.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95


LM = [(k, " ".join(random.Random(k).choices(["the", "cat", "Sat", "on", "mat", "dog", "ran"], k=1 + k % 30))) for k in range(80)] + [(200, None), (201, ""), (202, "unseen words wholly"), (203, "ÉTÉ été \x0b x"), (None, "the cat")]


def brute_lm(rows):
    toks = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter(w for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10 for w in toks(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))) for d, t in rows}


@pytest.mark.parametrize("head", [3, 50_000])
def test_lm_base_scores_are_exact_and_the_model_is_a_distribution(spark, head):
    docs = spark.createDataFrame(LM + LM[:1], "doc_id long, text string")
    from pyspark.sql import functions as F

    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10))
    model, counts = lm_score.train(spark, docs.dropDuplicates().where(part != 0), head=head)
    got = lm_score.score(spark, docs.withColumn("held_out", F.coalesce(part == 0, F.lit(False))), model, counts).collect()
    want = brute_lm(LM)
    assert len(got) == len(LM) + 1
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and np.isfinite(r["score"]) and r["score"] < 0
    w = np.random.default_rng(1).normal(size=(8, len(model.bias))).astype(np.float32)
    z, e, total = lm_score._softmax(model.bias, w, np.arange(8).reshape(4, 2))
    assert (e / total[:, None]).sum(1) == pytest.approx(1, abs=1e-4) and np.allclose(np.exp(z), e)
    # the units of a class share all of its probability, also when pairs have weights
    shares = np.bincount(model.cls, model.share, len(model.bias))
    assert shares == pytest.approx(1)
    met = np.nonzero(model.cls == model.cls[0])[0]
    v, log_sum = lm_score.pair_weights(np.arange(1.0, len(met) + 1), model.share[met], np.zeros(len(met), int))
    assert np.sum(model.share[met] * np.exp(v - log_sum[0])) == pytest.approx(1)
    # in a class, known words and one unseen share all of its probability
    for k, c in enumerate(model.class_n):
        mine = sum(r["c"] + 0.1 for r in counts.where(F.col("cls") == k).collect()) + 0.1
        assert mine == pytest.approx(c + 0.1 * (model.class_v[k] + 1))


def test_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, held_out boolean")
    model, counts = lm_score.train(spark, docs.limit(0).select("doc_id", "text"))
    r = lm_score.score(spark, docs, model, counts).first()
    assert r["base_score"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"])


def test_pair_weights_are_where_the_gradient_vanishes():
    n, share, group = np.array([5.0, 1, 1, 40]), np.array([0.1, 0.2, 0.05, 0.3]), np.array([0, 0, 1, 1])
    w, log_sum = lm_score.pair_weights(n, share, group, steps=200)
    met = np.array([6.0, 6, 41, 41])
    assert n - met * share * np.exp(w - log_sum[group]) - w / lm_score.PRIOR == pytest.approx(0, abs=1e-6)


def test_events_survive_packing():
    rng = np.random.default_rng(0)
    last = np.sort(rng.integers(0, 1 << 32, 50, np.uint32).repeat(rng.integers(1, 900, 50)))
    n = len(last)
    rows, unit, doc = [rng.integers(0, 1 << 16, n).astype(np.uint16) for _ in range(3)], rng.integers(0, 1 << lm_score.UNIT, n).astype(np.uint32), rng.integers(0, 2 * lm_score.DOCS, n).astype(np.uint16)
    got = lm_score._unpack(lm_score._pack(last, rows, unit, doc))
    assert (got[0] == last).all() and all((a == b).all() for a, b in zip(got[1], rows, strict=True)) and (got[2] == unit).all() and (got[3] == doc).all()


@pytest.mark.parametrize("shard", [lm_score.SHARD, 2000])
def test_lm_tells_held_out_order(spark, shard):
    """Held-out texts score above their base, and above the same words shuffled, with one shard or many."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = [f"{a}{b}{c}on" for a in "bcdfglmnpr" for b in "aeiou" for c in "tvz"]  # of one class
    after = {w: rng.sample(words, 3) for w in words}

    def text(n=40):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    texts = [text() for _ in range(400)]
    rows = [(k, " ".join(t), False) for k, t in enumerate(texts)] + [(1000 + k, " ".join(t), True) for k, t in enumerate(text() for _ in range(40))]
    rows += [(2000 + k, " ".join(rng.sample(t.split(), 40)), True) for k, (_, t, _) in enumerate(rows[400:440])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    model, counts = lm_score.train(spark, docs.where(~F.col("held_out")), shard=shard)
    assert (model.shards == 1) == (shard == lm_score.SHARD)
    got = {r["doc_id"]: r for r in lm_score.score(spark, docs, model, counts).collect()}
    held = [got[1000 + k] for k in range(40)]
    assert sum(r["score"] > r["base_score"] + 10 for r in held) == 40
    assert sum(got[1000 + k]["score"] > got[2000 + k]["score"] + 10 for k in range(40)) == 40


def grams(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows, percent=85):
    sets = {d: grams(t) for d, t in rows}
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for f in range(12):
        base = [word() for _ in range(120)]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t).upper() if f % 2 else "\t".join(t))
    rows += [None, "", "   ", "short text", "SHORT  text", "one", "one two three four five", rows[0], rows[5]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, b"x") for d, t in rows] + [(None, "one two", b"x")], "doc_id long, text string, sig binary")
    for percent, block in ((85, 2048), (80, 3)):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark, docs, percent=percent).collect()}
        assert got.pop(None) == (1, None)
        assert got == brute_near(rows, percent)


def test_near_duplicates_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark, docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert near_dup.near_duplicates(spark, docs.limit(0)).count() == 0


def test_every_pair_within_the_threshold_shares_a_key():
    rng = np.random.default_rng(2)
    t = near_dup.allowed(60, 0.85, 16)
    chunks = -(-(t + 1) // 2)
    for _ in range(300):
        x = rng.integers(0, 1 << 16, (1, 60))
        y = x.copy()
        y[0, rng.choice(60, t, replace=False)] += 1
        a, b = (near_dup.keys_of(z, chunks, 1) for z in (x, y))
        assert (a == b).any()
