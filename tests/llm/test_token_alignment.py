"""Token alignment against plain Python with both tokenizer libraries."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwise.llm import align

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "plain words, and plain words again"),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "  two  spaces   and\ttabs\n\nlines \r\n"),
    (6, "<|endoftext|> and </s> and <0x0A> stay text"),
    (7, "\N{LOWER ONE EIGHTH BLOCK}changed by the second vocabulary"),
    (8, "é ß 漢字 😀 ﬁ \x00 \x85"),
    (9, "a" * 5000 + " " * 3000 + "b1" * 2000),
    (10, "plain words, and plain words again"),
    (10, "plain words"),
    (None, "no id"),
]


def brute(rows):
    """Per row: n_a, n_b, n_groups, n_links, n_best, count_sum, groups; and the count of each pair."""
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {i: bytes(names[c] for c in t) for t, i in a_lib.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}

    def b_bytes(i):
        return bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("\N{LOWER ONE EIGHTH BLOCK}", " ").encode()

    found = []
    for _, text in rows:
        groups, links = [], Counter()
        a = [(i, vocab[i]) for i in a_lib.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, b_bytes(i)) for i in b_lib.encode(text)] if text else []
        own = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) == own == b"".join(x for _, x in b):
            at_a = at_b = end_a = end_b = 0
            now = ([], [])
            while at_a < len(a) or at_b < len(b):
                if end_a <= end_b:
                    now[0].append(a[at_a][0])
                    end_a += len(a[at_a][1])
                    at_a += 1
                else:
                    now[1].append(b[at_b][0])
                    end_b += len(b[at_b][1])
                    at_b += 1
                if end_a == end_b:
                    groups.append(now)
                    links.update((x, y) for x in now[0] for y in now[1])
                    now = ([], [])
        found.append((groups, links))
    count = Counter(p for _, links in found for p in links)
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((*n, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), shown))
    return out, count


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("head", [align.HEAD, 0])
def test_odd_texts_match_brute_force(spark, head):
    docs = spark.createDataFrame([(d, t, "own", 5) for d, t in ODD], "doc_id long, text string, groups_sha256 string, N_A int")
    found, pairs = align.align_documents(docs, head=head)
    want, count = brute(ODD)
    assert sorted(found.columns) == sorted(["doc_id", "text", "groups_sha256", *COLS, "groups"])
    assert Counter((r["doc_id"], r["text"], r["groups_sha256"], *[r[c] for c in COLS], r["groups"]) for r in found.collect()) == Counter((d, t, "own", *w) for (d, t), w in zip(ODD, want, strict=True))
    got = {(r["a_id"], r["b_id"]): (r["c"], r["best"]) for r in pairs.collect()}
    assert {k: c for k, (c, _) in got.items()} == count
    assert all(best == (c == max(count[p] for p in count if p[0] == a)) for (a, _), (c, best) in got.items())


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found, pairs = align.align_documents(docs)
    assert found.count() == 0 and pairs.count() == 0


def test_names_of_its_own_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, True, "x")], "doc_id long, text string, row int, codes int, partial boolean, pair string")
    r = align.align_documents(docs)[0].collect()[0]
    assert (r["row"], r["codes"], r["partial"], r["pair"], r["n_a"], r["n_links"]) == (1, 2, True, "x", 2, 2)


def test_a_long_text_in_one_group_is_no_square(spark):
    """Where the tokenizers agree nowhere, ids are counted before they are joined."""
    text = "漢" * 400 + "word " * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = align.align_documents(docs)[0].select("n_groups", "n_links", F.length("groups").alias("n")).collect()[0]
    (want,), _ = brute([(1, text)])
    assert (r["n_groups"], r["n_links"], r["n"]) == (want[2], want[3], len(want[6]))


def test_query_matches_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want, _ = brute(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    got = {r["doc_id"]: (*[r[c] for c in COLS], r["groups_sha256"]) for r in align.op11_token_alignment(spark, SF).collect()}
    assert got == {d: (*w[:-1], sha(w[-1])) for (d, _), w in zip(rows, want, strict=True)}
