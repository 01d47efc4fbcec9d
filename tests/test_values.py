"""Values of queries without SQL, against plain Python or what must hold of them; and odd tables."""

import os
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwise.operators import direction, gallery, selection, similarity
from loomwise.plans import grading, items
from loomwise.queries import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def graded(spark):
    return {r["idx"]: r for r in grading.graded(spark, SF).collect()}


def value(v, a, s):
    s = list(s)
    cos = (v[s] @ v[s].T)[np.triu_indices(len(s), 1)]
    return a[s].mean() + (1 - cos.mean() if len(s) > 1 else 0)


@pytest.mark.parametrize("seed", range(3))
def test_portfolio_against_all_sets_of_30_rows(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(30, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score, personal = rng.random(30), rng.random(30)
    df = spark.createDataFrame([(i, v[i].tolist(), float(score[i]), float(personal[i])) for i in range(30)], "idx long, v array<double>, score double, personal double")
    got = selection.portfolio(df.repartition(4), 4).collect()
    mine = value(v, score + personal, [r["idx"] for r in got])
    best = max(value(v, score + personal, c) for c in combinations(range(30), 4))
    assert got[0]["value"] == pytest.approx(mine) and mine >= 0.98 * best and got[0]["bound"] >= best
    # no exchange of one row makes the set better
    ids = [r["idx"] for r in got]
    assert all(value(v, score + personal, [*(set(ids) - {x}), y]) <= mine + 1e-8 for x in ids for y in set(range(30)) - set(ids))


def test_portfolio_query_sees_every_row(spark, graded):
    got = QUERIES["portfolio_topn"](spark, SF).collect()
    rows = list(graded.values())
    v, a = np.array([r["v"] for r in rows]), np.array([r["score"] + r["personal"] for r in rows])
    at = [i for i, r in enumerate(rows) if r["idx"] in {g["idx"] for g in got}]
    mine = value(v, a, at)
    assert len(at) == 5 and got[0]["value"] == pytest.approx(mine, abs=1e-6) and got[0]["bound"] >= mine
    for x in at:
        rest = [i for i in at if i != x]
        one, pair = a[rest].sum() + a, (v[rest] @ v[rest].T)[np.triu_indices(4, 1)].sum() + (v @ v[rest].T).sum(1)
        swap = one / 5 + 1 - pair / 10
        swap[at] = -9
        assert swap.max() <= mine + 1e-8


def test_portfolio_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 0.5, 0.5), (2, None, 1.0, 1.0)], "idx long, v array<double>, score double, personal double")
    assert [tuple(r) for r in selection.portfolio(df).collect()] == [(1, 1.0, 1.0)]
    assert selection.portfolio(df.limit(0)).count() == 0


def test_kmeans_labels_are_nearest_means(spark, graded):
    got = {r["id"]: r["label"] for r in QUERIES["kmeans_labels"](spark, SF).collect()}
    want = {i for i, r in graded.items() if r["score"] > 0.20}
    assert set(got) == want and set(got.values()) == set(range(10))
    v = {i: np.array(graded[i]["v"]) for i in got}
    means = np.array([np.mean([v[i] for i in got if got[i] == k], 0) for k in range(10)])
    near = sum(np.linalg.norm(means - v[i], axis=1).argmin() == got[i] for i in got)
    assert near >= 0.97 * len(got)


def test_preference_rank_puts_winners_first(spark):
    got = {r["id"]: r["personal_score"] for r in QUERIES["preference_rank"](spark, SF).collect()}
    it = sorted((r["label"], r["exif_ts"], r["idx"], r["personal"]) for r in items.items(spark, SF).collect())
    pairs = [(a[2], b[2]) if a[3] > b[3] else (b[2], a[2]) for a, b in zip(it, it[1:], strict=False) if a[0] == b[0] and a[3] != b[3]]
    assert len(pairs) > 20 and set(got) == {r[2] for r in it} and all(0 < x < 1 for x in got.values())
    assert np.mean([got[w] > got[l] for w, l in pairs]) > 0.8


def test_story_is_a_unique_sequence_in_its_order(spark, graded):
    got = sorted(QUERIES["story_select"](spark, SF).collect(), key=lambda r: r["pos"])
    pool = sorted(graded.values(), key=lambda r: (-r["score"], r["idx"]))[:40]
    assert [r["pos"] for r in got] == list(range(10)) and len({r["idx"] for r in got}) == 10
    assert {r["idx"] for r in got} <= {r["idx"] for r in pool} and pool[0]["idx"] in {r["idx"] for r in got}
    assert got[0]["role"] == "opener" and got[5]["role"] == "contrast" and got[9]["role"] == "closer"
    assert all(r["score"] == pytest.approx(graded[r["idx"]]["score"]) for r in got)


def test_creative_direction_keeps_its_gates(spark, graded):
    got = QUERIES["creative_direction"](spark, SF).collect()
    pool = {r["idx"]: r["score"] for r in QUERIES["direction_pool"](spark, SF).collect()}
    assert len(got) == 5 and len({r["idx"] for r in got}) == 5
    for r in got:
        assert r["score"] == pytest.approx(pool[r["idx"]], abs=1e-6)
        assert (r["file"], r["outcome"], r["note"]) == (f"item_{r['idx']}_purist.jpg", "copied", graded[r["idx"]]["log"])
        assert r["log"].startswith(f"Role: {r['role'].upper()} ") and f"Score: {r['score']:.3f}" in r["log"] and "No people: false" in r["log"]
    assert [r["pos"] for r in sorted(got, key=lambda r: r["pos"])] == list(range(5))
    v = np.array([graded[r["idx"]]["v"] for r in got])
    assert (v @ v.T)[np.triu_indices(5, 1)].max() <= 0.35


def test_a_brief_sets_weights_gates_and_penalty(spark):
    one = lambda b: direction.settings(spark, b).first().asDict()
    plain = one("")
    assert not plain["hard"] and not plain["empty"] and {k: v for k, v in plain.items() if k.startswith("w_")} == {f"w_{a}": w for a, w in direction.NEUTRAL.items()}
    s = one("Empty desert at sunset, a decisive moment")
    assert s["hard"] and s["empty"] and (s["w_human"], s["w_light"], s["w_narr"], s["w_comp"]) == (0.0, 2.8, 2.8, 1.0) and s["lighting"] == "warm golden"
    assert one("a grid of lines")["w_comp"] == 2.8 and one("crowd")["w_human"] == 2.5 and not one("nobody")["hard"] and one("nobody")["empty"]


def test_paths_to_avoid_unless_there_are_no_others(spark):
    eye = np.eye(4).tolist()
    rows = [(i, f"p{i}", eye[i], 0.5 + i / 10, 0.5, 0.5, 0.5, 0.5, 0.0, 100.0, "hard" if i == 3 else "pass", i != 2, [0.0] * 36) for i in range(4)]
    df = spark.createDataFrame(rows, "idx long, path string, v array<double>, score double, tech double, comp double, light double, narr double, human double, lum double, gate string, sharp boolean, sims array<double>")
    ids = lambda brief, avoid=None: {r["idx"] for r in direction.directed(df, direction.settings(spark, brief), 0.9, 3, avoid).collect()}
    assert ids("a street") == {0, 1, 3} and ids("an empty street") == {0, 1}
    some = spark.createDataFrame([("p0",), ("p0",)], "path string")
    assert ids("a street", some) == {1, 3}
    assert ids("an empty street", some.union(spark.createDataFrame([("p1",)], "path string"))) == {0, 1}


def test_scan_fingerprints_are_sizes_and_times(spark):
    got = {r["name"]: r["fingerprint"] for r in QUERIES["scan_fingerprint"](spark, SF).collect()}
    files = [os.path.join(d, f) for d, _, fs in os.walk(SF) for f in fs if f.endswith(".parquet")]
    assert got == {os.path.basename(f): f"{os.stat(f).st_size}-{int(os.stat(f).st_mtime)}" for f in files}


def test_flags_of_a_cluster_with_most_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"a/p{i}", None if i % 50 == 0 else float(np.round(rng.random(), 2)), 1 if i % 10 else int(i) - 500) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, path string, score double, cluster_id int").repartition(6)
    flags = {r["id"]: r["sim_flag"] for r in similarity.duplicate_flags(df).collect()}
    kept = {r["id"] for r in similarity.best_of_cluster(df).collect()}
    groups = {}
    for i, p, s, c in rows:
        groups.setdefault(c, []).append((s is None, -(s or 0), i, p))
    for c, m in groups.items():
        best = min(m)
        for none, o, i, _ in m:
            if c < 0 or len(m) == 1:
                assert flags[i] == ""
            elif i == best[2]:
                assert flags[i] == f"Best of {len(m)} similar (score {-best[1]:.2f})"
            else:
                assert flags[i].startswith(f"Duplicate: {best[3].rpartition('/')[2]} is better")
    assert kept == {min(m)[2] for c, m in groups.items() if c >= 0} | {i for c, m in groups.items() if c < 0 for _, _, i, _ in m}
    for f in (similarity.duplicate_flags, similarity.best_of_cluster):
        assert "Window" not in f(df)._jdf.queryExecution().toString()


def test_similarity_of_odd_tables(spark):
    kind = "id long, v array<double>"
    three = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], kind)
    for block in (1, 2, 1024):
        assert [tuple(r)[:2] for r in similarity.edges(three, 0.5, block=block).collect()] == [(1, 2)]
    none = three.limit(0)
    assert similarity.edges(none, 0.5).count() == 0 and similarity.lsh_edges(none, 0.5).count() == 0
    assert similarity.CellIndex(none).search(none).count() == 0
    assert similarity.CellIndex(three.limit(1)).search(three, probes=1).count() == 2
    rank = similarity.preference_rank(spark.createDataFrame([], "winner long, loser long"), three)
    assert {r["personal_score"] for r in rank.collect()} == {0.5} and rank.count() == 4


def test_unified_rows_say_where_each_field_is_from(spark):
    stored = spark.createDataFrame([("a", [1.0, 2.0], 0.3, "Weak", 0.0, 0.7, 5.0), ("b", None, None, None, None, None, None), ("c", [1.0] * 5, 0.9, "0.8", 0.4, 0.2, 1.0), (None, [1.0], 1.0, "x", 1.0, 1.0, 1.0)], "path string, embedding array<double>, score double, grade string, quality double, personal_score double, exif_ts double")
    cache = spark.createDataFrame([("a", "Strong", None, "sharp", 2), ("c", "", 0.1, None, None), ("c", "", 0.1, None, None), ("z", "Mid", 1.0, "", 0)], "path string, grade string, score double, critique string, faces int")
    got = {r["path"]: r for r in gallery.unified(stored, cache, 3).collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = (got[k] for k in "abc")
    assert (a["vector"], a["grade"], a["score"], a["level"], a["personal_score"], a["faces"]) == ([1.0, 2.0, 0.0], "Strong", 0.3, 2, 0.7, 2)
    assert a["origin"].asDict() == {"grade": "cache", "score": "stored", "critique": "cache", "faces": "cache", "exif_ts": "stored", "personal_score": "stored"}
    assert (b["vector"], b["grade"], b["score"], b["level"], b["personal_score"]) == ([0.0] * 3, "", 0.0, 1, 0.5) and set(b["origin"]) == {"default"}
    assert (c["vector"], c["grade"], c["score"], c["level"], c["personal_score"]) == ([1.0] * 3, "0.8", 0.1, 2, 0.4)


def test_a_gallery_row_has_every_field(spark):
    df = spark.createDataFrame([("x/a.jpg", "Strong", 0.61249, 0.5, [1.0], None, {"tech": 0.12345, "Personal": 0.9}, None, -1, "")], "path string, grade string, score double, personal double, v array<double>, exif_ts double, more map<string,double>, stars int, cluster_id int, sim_flag string")
    r = gallery.projection(gallery.rows(df), "more").first()
    assert len(r) == 19 and (r["id"], r["filename"], r["score"], r["rating"], r["exif_ts"], r["stars"], r["reject"]) == ("x/a.jpg", "a.jpg", 0.612, 0.612, 0.0, 0, False)
    assert r["breakdown"] == {"Aesthetic": 0.612, "Personal": 0.9, "tech": 0.123}
    assert gallery.projection(gallery.rows(df.withColumn("more", F.lit(None).cast("map<string,double>"))), "more").first()["breakdown"] == {"Aesthetic": 0.612, "Personal": 0.5}
