"""Decontamination, line dedup and URL rules against brute force on small fixtures."""

import hashlib
import re

from loomwise.llm import decontaminate as dec
from loomwise.llm import line_dedup as ld
from loomwise.llm import url_rules as ur

DOC = "doc_id long, text string, lang string, key string"
W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (4, ""), (None, "naked id words"), (5, "ÉCOLE à l'été"), (1, "repeated id item text")]
DOCS = [
    (1, "x ONE, two-three four five six seven eight nine ten! eleven y"),
    (2, "a short item and another SHORT   ITEM."),
    (3, None),
    (4, ""),
    (5, "... !!! ???"),
    (6, "one two three four five six seven eight nine eleven"),
    (6, "one two three four five six seven eight nine ten"),
    (6, "one two three four five six seven eight nine ten"),
    (None, "École à l'été; ÉCOLE à l'été"),
    (7, "clean " * 3000 + "naked id words"),
]


def brute(items, docs, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, who in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {str(x) for x in who if x is not None}
        out.append((d, len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=repr)


def frames(spark):
    docs = spark.createDataFrame([(d, t, "en", "k") for d, t in DOCS], DOC)
    return docs, spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, h string")


def test_decontaminate_matches_brute_force(spark):
    docs, items = frames(spark)
    got = sorted(((r["doc_id"], r["n_words"], r["hit_words"], r["items"]) for r in dec.report(docs, items).collect()), key=repr)
    assert got == brute(ITEMS, DOCS)
    again = sorted(((r["doc_id"], r["n_words"], r["hit_words"], r["items"]) for r in dec.report(docs, items, set_limit=0).collect()), key=repr)
    assert again == got  # the join by shuffle gives the same


def test_decontaminate_removes_documents_or_spans(spark):
    docs, items = frames(spark)
    clean = [r for r in brute(ITEMS, DOCS) if not r[2]]
    left = dec.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == len(clean)
    texts = {r["doc_id"]: r["text"] for r in dec.decontaminate(docs, items, remove="spans").collect()}
    assert texts[1] == "x  y" and texts[2] == "a  and another ." and texts[3] is None and texts[5] == "... !!! ???"


def test_windows_of_many_lengths_by_broadcast_and_by_shuffle(spark):
    items = [("a", "one two three"), ("b", " ".join(f"w{k}" for k in range(14))), ("c", "w3 w4"), ("d", "zz"), ("e", None), (None, "w9 w10 w11")]
    docs = [(1, "zz one two three zz " + items[1][1]), (1, "zz one two three zz " + items[1][1]), (2, "w3"), (3, None), (None, "x w3 w4 zz"), (4, " ".join(["w3 w4"] * 3000))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    by = [sorted(map(repr, dec.report(d, i, set_limit=limit).collect())) for limit in (0, 500)]
    assert by[0] == by[1] and len(by[0]) == len(docs)
    hit = {r["doc_id"]: (len(r["hit_words"]), r["items"]) for r in dec.report(d, i).collect()}
    assert hit == {1: (19, ["a", "b", "c", "d"]), 2: (0, []), 3: (0, []), None: (3, ["c", "d"]), 4: (6000, ["c"])}
    clean = {r["doc_id"]: r["text"] for r in dec.decontaminate(d, i, remove="spans").collect()}
    assert clean[1] == "" and clean[2] == "w3" and clean[3] is None and clean[None] == "x " and clean[4] == ""


def test_decontaminate_empty_tables(spark):
    docs, items = frames(spark)
    assert dec.report(docs.limit(0), items).count() == 0
    assert dec.decontaminate(docs, items.limit(0)).count() == len(DOCS)


LINES = [
    (1, "A very common footer line\nown line one\nA VERY common footer line  "),
    (2, "  a very common footer line\r\nshort"),
    (3, "A very common footer line\nshort"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (9, "short\na line that only two documents hold"),
    (10, "a line that only two documents hold\nshort"),
    (None, "a very common footer line\nnull id"),
    (11, "émile zola écrivait ici\nx"),
    (12, "émile zola écrivait ici"),
    (13, "Émile zola écrivait ici"),
]


def brute_lines(rows, least=20, docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    low = lambda d: -(2**63) if d is None else d
    held = {}
    for d, t in rows:
        for x in set(map(key, (t or "").split("\n"))):
            if len(x) >= least:
                held.setdefault(x, set()).add(low(d))  # rows that repeat a doc_id are one document, as in the SQL
    gone = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if gone.get(key(x), low(d)) == low(d)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "en", "k") for d, t in LINES], DOC)
    for batches in (1, 4, 9):
        got = ld.dedup_lines(spark, docs, batches=batches, fanout=2)
        rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=repr)
        assert rows == brute_lines(LINES)
    assert ld.dedup_lines(spark, docs.limit(0)).count() == 0


def test_line_runs_levels_and_anti_join(spark):
    runs = ld.LineRuns(spark, keep=3, fanout=2)
    for k in range(4):
        docs = spark.createDataFrame([(100 - k, f"line number {k} is long enough\nthis line is in every batch")], "doc_id long, text string")
        runs.add(ld.lines_of(docs, 20))
    assert [len(x) for x in runs.state["levels"]] == [0, 0, 1]
    top = runs.frequent().collect()
    assert len(top) == 1 and top[0]["owner"] == 100
    # what the runs have settled is not added again, what is larger is
    again = spark.createDataFrame([(bytes(top[0]["h"]), [50]), (bytes(top[0]["h"]), [200]), (b"new", [1])], "h binary, docs array<bigint>")
    assert sorted(r["docs"][0] for r in runs.unsettled(again).collect()) == [1, 200]


def test_line_runs_are_kept_and_take_batches_in_any_order(spark):
    """Owners and counts after calls in any order, a repeated one among them, are those of one call."""
    rows = [(k, f"only document {k} has this line\nthis line is in all documents\n" + ("some of the documents have this" if k % 3 else "")) for k in range(12)]
    parts = [rows[4:8], rows[8:], rows[:4], rows[4:8]]
    folder = ld.scratch_path(spark, "kept-runs")
    for p in parts:
        ld.LineRuns(spark, folder=folder).add(ld.lines_of(spark.createDataFrame(p, "doc_id long, text string"), 20))
    owners = {bytes(r["h"]): r["owner"] for r in ld.LineRuns(spark, folder=folder).frequent().collect()}
    once = ld.LineRuns(spark)
    once.add(ld.lines_of(spark.createDataFrame(rows, "doc_id long, text string"), 20))
    assert owners == {bytes(r["h"]): r["owner"] for r in once.frequent().collect()} and sorted(owners.values()) == [11, 11]
    late = spark.createDataFrame([(50, rows[0][1])], "doc_id long, text string")
    got = ld.dedup_lines(spark, late, folder=folder).first()
    assert got["n_dropped"] == 0  # the largest document, with all that came before
    older = ld.dedup_lines(spark, spark.createDataFrame(rows[:1], "doc_id long, text string"), folder=folder).first()
    assert older["n_dropped"] == 1


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/ok", "allow"), ("EXAMPLE.org", "/es/ok/no", "block"), ("", "/", "block"), (None, "/", "block"), ("a.b.example.org", "", "block")]
URLS = [
    (1, "http://www.Example.ORG/es/1?x#y"), (2, "https://example.org/es/ok/no/2"), (3, "https://example.org/es/okay"), (4, "http://org/"), (5, "http://org"), (6, "ftp://notexample.org/es/1"),
    (7, None), (8, "no scheme"), (9, ""), (10, "http://a.b.example.org"), (10, "http://a.b.example.org"), (11, "http://x.a.b.example.org/es/q"), (12, "http://é.org/é"), (None, "http://example.org/es/"), (13, "http://" + "z." * 500 + "org/" + "p" * 9000),
]


def brute_urls(rules, urls):
    out = []
    for p, u in urls:
        host = path = ""
        if u and "://" in u:
            rest = re.split(r"[?#]", u.split("://", 1)[1], maxsplit=1)[0]
            host, slash, path = rest.partition("/")
            path = slash + path
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        best = max(((len(h) + len(q), len(h), h.lower() + q, v) for h, q, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(q)), default=(0, 0, None, "allow"))
        out.append((p, host, path, best[2], best[3]))
    return sorted(out, key=repr)


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(p, u, "h") for p, u in URLS], "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for rows in (1, 512):
        got = ur.judge_urls(pages, rules, group_rows=rows).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(map(tuple, got.collect()), key=repr) == brute_urls(RULES, URLS)
    none = ur.judge_urls(pages, rules.limit(0))
    assert none.count() == len(URLS) and none.where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
    assert ur.judge_urls(pages.limit(0), rules).count() == 0


def test_digest(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert ld.dedup_lines(spark, docs).first()["kept_text"] == ""
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
