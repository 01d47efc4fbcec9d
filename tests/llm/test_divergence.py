"""Source divergence against plain Python in exact integers."""

import re
from collections import Counter, defaultdict

import pytest

from loomwise.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ONE = 10**9


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, least=3, top=200):
    rows = [((lang or ""), (source or ""), terms(t)) for t, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t in df if df[t] >= least)
        count = defaultdict(Counter)
        for _, s, w in own:
            count[s].update(x for x in w if df[x] >= least)
            count[None].update(x for x in w if df[x] >= least)
        share = {s: {t: 1 + ONE * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        apart = lambda p, q: (p - q) ** 2 // q
        for s in count:
            if s is None:
                continue
            parts = {
                "pair": [(x, sum(apart(share[s][t], share[x][t]) for t in kept)) for x in count if x not in (None, s)],
                "term": [(t, apart(share[s][t], share[None][t])) for t in kept if count[s][t] and share[s][t] > share[None][t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


WORDS = "alpha Beta GAMMA delta été naïve 漢字 one two three x1y don't".split()
ROWS = [(" ".join(WORDS[(i * k) % len(WORDS)] for k in range(1 + i % 9)), ["en", "fr", None, ""][i % 4], ["a", "b", "c", None, "é"][i * i % 5]) for i in range(120)]
ODD = [*ROWS, (None, "en", "a"), ("", "en", "empty"), ("123 !! 45", "en", "digits"), ("alone", "de", "only"), ("lonely words", "it", "x"), ("other words", "it", "y"), ("word " * 20000 + "alpha beta", "en", "long"), *ROWS[:3], *ROWS[:3]]


@pytest.mark.parametrize("top", [200, 2])
def test_audit_matches_brute_force(spark, top):
    docs = spark.createDataFrame([(t, x, s, 1, "c") for t, x, s in ODD], "text string, lang string, source string, k int, counts string")
    got = sorted(tuple(r) for r in divergence.audit(docs, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(ODD, top=top)


def test_one_source_holds_most_rows(spark):
    rows = [("the hot line of words", "en", "hot")] * 900 + [("the words elsewhere", "en", f"s{i % 7}") for i in range(70)]
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect())
    assert got == brute(rows)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    cases = [(1, 3), (10**9, 10**9 + 7), (9 * 10**9, 10**10), (9 * 10**9 + 1, 9 * 10**9 + 1), (123456789012345, 987654321098765), (8 * 10**15, 9 * 10**15)]
    df = spark.createDataFrame(cases, "x long, m long")
    got = {(r["x"], r["m"]): r["p"] for r in df.selectExpr("x", "m", f"{divergence._share('x', 'm')} AS p").collect()}
    assert got == {(x, m): 1 + ONE * x // m for x, m in cases}
