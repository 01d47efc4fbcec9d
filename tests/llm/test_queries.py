"""The registered queries over the smallest tables: against their SQL, or against plain Python where there is none."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomwise.llm import bpe, langid, lm_score, registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([row[c] for c in names]) for row in df.collect()) == sorted(repr(list(row)) for row in r.fetchall())


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_bpe_query_equals_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for d, t, _ in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op3_bpe(spark, SF).collect()}
    assert got == want


def test_language_query_sums_all_segmentations(spark, texts):
    """lang_pred and score of every document, from its words' probabilities summed word by word in plain Python."""
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in langid.op2_language_id(spark, SF).collect()}
    assert {d for d, _, _ in texts} == set(got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.train(spark, docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)))
    pieces = langid._load(None, m.vocabulary)
    import sentencepiece
    import public_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(m.vocabulary))
    number = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        body = p.removeprefix(langid.START)
        if p == p.lower() and (body == "" or langid.WORD.fullmatch(body)):
            number[p] = len(number)
    assert len(number) == pieces.n - 1

    def log_word(w):
        s = langid.START + w
        total = [np.ones(len(m.languages))] + [np.zeros(len(m.languages)) for _ in s]
        for i in range(len(s)):
            for k in range(1, min(pieces.longest, len(s) - i) + 1):
                piece = s[i : i + k]
                at = number.get(piece, pieces.n - 1 if k == 1 else None)
                if at is not None:
                    total[i + k] = total[i + k] + total[i] * m.p[at]
        return np.log(total[-1])

    known, checked = {}, 0
    for d, t, _ in texts[:60]:
        words = langid.WORD.findall((t or "").lower())
        r = got[d]
        assert r["held_out"] == (part(d, 4) == 2)
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        if max(map(len, words)) > langid.LONG:
            continue
        for w in words:
            if w not in known:
                known[w] = log_word(w)
        z = m.priors + sum(known[w] for w in words)
        assert m.languages[int(z.argmax())] == r["lang_pred"]
        assert r["score"] == pytest.approx(1 / np.exp(z - z.max()).sum(), abs=1e-6)
        checked += 1
    assert checked > 20


def test_lm_query_base_scores(spark, texts):
    toks = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter(w for d, t, _ in texts if part(d, 10) for w in toks(t))
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm_score.op5_lm_score(spark, SF).collect()}
    for d, t, _ in texts:
        r = got[d]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part(d, 10) == 0, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n)
        assert r["base_score"] == pytest.approx(base) and np.isfinite(r["score"])
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages over a small table of odd rows and a clashing column, in plain Python but for the language model."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from pyspark.sql import functions as F
    from test_native_and_lines import brute_lines
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 70").withColumn("n_dropped", F.col("doc_id") * 3)
    odd = [(900, None, None, "s", 0), (901, "", "en", "s", 0), (902, "12 34 !?", "en", "s", 0)]
    base = docs.where(F.length("text") > 400).orderBy("doc_id").first()["text"]
    odd += [(903, base, "en", "s", 1), (904, base.replace(base.split()[40], "altered", 1), None, "s", 1)]
    item = "a passage of the benchmark that is long enough to fill more than one window"
    odd += [(905, f"{base.split()[0]} something else is said here first, then {item} and more", "en", "s", 1)]
    docs.unionByName(spark.createDataFrame([(*r, 5) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, n_dropped long")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("x", item), ("y", None), ("z", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["lang"], r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    found = langid.train(spark, spark.read.parquet(f"{tmp_path}/documents.parquet")).predict(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    lang = {r["doc_id"]: r["lang"] or r["lang_pred"] for r in found if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    text = {d: kept if dropped else rows[d]["text"] for d, _, dropped, kept in brute_lines([(d, rows[d]["text"]) for d in lang])}

    def shingled(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingled(t) for d, t in text.items()}
    comp = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    text = {d: t for d, t in text.items() if comp[d] == d}
    words = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").translate({k: " " for k in range(128) if not chr(k).isalnum()}).split(" ") if w]
    n = len(words(item))
    windows = {tuple(words(item)[k : k + 10]) for k in range(n - 9)}
    text = {d: t for d, t in text.items() if not windows & {tuple(words(t)[k : k + 10]) for k in range(len(words(t)) - 9)}}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for d, t in text.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (lang[d], len(ids), ids)
    assert got == want
    assert not {900, 901, 902, 905} & set(got)  # nothing to tell a language by, or a passage of the benchmark
