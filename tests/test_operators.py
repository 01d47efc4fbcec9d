"""Operators on hand-made rows: ties, limits, nulls and empty tables."""

import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwise.functions import scalar, vectors
from loomwise.operators import constraints, gallery, niche, scoring, selection, similarity, skyline, store, timeline
from loomwise.session import scratch_path
from loomwise.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_vectors(spark):
    a = F.array(*[F.lit(float(x)) for x in (3, 4)])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.unit(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.unit(zero)) == [0, 0] and one(spark, vectors.cosine(a, zero)) == 0
    assert one(spark, vectors.fit(a, 3)) == [3, 4, 0] and one(spark, vectors.fit(a, 1)) == [3]
    assert one(spark, vectors.fit(F.lit(None).cast("array<double>"), 2)) == [0, 0]
    assert one(spark, vectors.hamming(F.lit(0b1011), F.lit(0b0010))) == 2


@pytest.mark.parametrize("score,grade", [(0.10, "Weak"), (0.405, "Weak"), (0.41, "Mid"), (0.595, "Mid"), (0.60, "Strong")])
def test_grades(spark, score, grade):
    assert one(spark, scalar.grade(F.lit(score))) == grade


def test_scalars(spark):
    assert one(spark, scalar.exif_seconds(F.lit("1970:01:02 00:00:01"))) == 86401 and one(spark, scalar.exif_seconds(F.lit("bad"))) == 0
    assert one(spark, scalar.camera_name(F.lit("Canon Inc"), F.lit("CANON R5"))) == "CANON R5"
    assert one(spark, scalar.camera_name(F.lit(None).cast("string"), F.lit(None).cast("string"))) is None
    assert one(spark, scalar.aspect_ratio(F.lit(1600.0), F.lit(900.0))) == "16:9"
    assert one(spark, scalar.star_rating(F.lit(0.5))) == 2 and one(spark, scalar.star_rating(F.lit(9.0))) == 5
    for bad in ("", "{", "[1]", "null"):
        assert one(spark, scalar.numbers_map(F.lit(bad))) == {}
    assert one(spark, scalar.numbers_map(F.lit('{"a": 1.5, "b": null}'))) == {"a": 1.5}
    assert one(spark, scalar.shutter(F.lit(0.004))) == "1/250s" and one(spark, scalar.exposure_bias(F.lit(-0.5))) == "-0.5 EV"


def test_components_canonical_ids(spark):
    pairs = spark.createDataFrame([(0, 2), (0, 4), (2, 3), (7, 8)], "a long, b long")
    got = {r["id"]: r["cluster"] for r in similarity.components(spark, pairs).collect()}
    assert got == {0: 0, 2: 0, 3: 0, 4: 0, 7: 7, 8: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["cluster"] for r in similarity.components(spark, chain).collect()} == {0}
    assert similarity.components(spark, pairs.limit(0)).count() == 0


def _unit_rows(n, dims=8, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]


def test_edges_do_not_depend_on_blocks(spark):
    rows = _unit_rows(60)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = sorted(map(tuple, similarity.edges_sql(df, 0.4).collect()))
    for block in (7, 1000):
        assert sorted(map(tuple, similarity.edges(df.repartition(5), 0.4, block=block).collect())) == want
    assert similarity.edges(df.limit(0), 0.4).count() == 0


def test_greedy_dedup_equals_the_sequential_pass(spark):
    rows = _unit_rows(80, 4, 3)
    rng = random.Random(1)
    score = {i: rng.choice([0.3, 0.5, 0.7]) for i, _ in rows}
    vec, kept = dict(rows), []
    for i in sorted(score, key=lambda i: (-score[i], i)):
        if all(np.dot(vec[i], vec[k]) <= 0.8 for k in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, v, score[i]) for i, v in rows], "id long, v array<double>, score double")
    assert sorted(r["id"] for r in similarity.greedy_dedup(spark, df, 0.8).collect()) == sorted(kept)


def test_duplicate_flags_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "a/p1", 0.7, 1), (2, "a/p2", 0.7, 1), (3, "a/p3", 0.5, 1), (4, "p4", None, 1), (5, "p5", 0.9, -1)], "id long, path string, score double, cluster_id int")
    got = {r["id"]: r["sim_flag"] for r in similarity.duplicate_flags(df).collect()}
    assert got[1] == "Best of 4 similar (score 0.70)" and got[2] == "Duplicate: p1 is better (+0.00)" and got[3].endswith("(+0.20)") and got[5] == ""
    assert {r["id"] for r in similarity.best_of_cluster(df).collect()} == {1, 5}


def test_event_gap_is_strict(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 900.0), (3, "a", 1801.0), (4, "a", 1801.0), (5, "z", 0.0), (6, "z", 0.0)], "id long, k string, exif_ts double")
    assert [r["event"] for r in timeline.segment_events(df, ["k"]).orderBy("id").collect()] == [0, 0, 1, 1, 0, 0]
    assert [r["event"] for r in timeline.events_by_range(df.where("k = 'a'")).orderBy("id").collect()] == [0, 0, 1, 1]


def test_burst_leader_is_not_a_component(spark):
    # neighbours are near each other, the ends are not
    v = [[np.cos(a), np.sin(a)] for a in (0.0, 1.1, 2.2)]
    df = spark.createDataFrame([(k, "a", 0, [float(x) for x in v[k]], 0.0, [0.5, 0.9, 0.4][k]) for k in range(3)], "id long, label string, event int, v array<double>, exif_ts double, score double")
    got = {r["id"]: r["burst_size"] for r in timeline.consolidate_bursts(df, ["label", "event"]).collect()}
    assert got == {1: 2, 2: 1}


def test_pareto_tolerance(spark):
    rows = [(1, 0.5, 0.5), (2, 0.5, 0.5), (3, 0.5 + 1e-10, 0.5), (4, 0.5 - 1e-8, 0.5), (5, 0.9, 0.1), (6, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "idx long, a double, b double")
    assert sorted(r["idx"] for r in skyline.skyline(df.repartition(3), ["a", "b"]).collect()) == [1, 2, 3, 5]
    assert skyline.skyline(df.limit(0), ["a", "b"]).count() == 0


def test_front_is_mutually_undominated(spark):
    rng = np.random.default_rng(2)
    x = rng.random((200, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "idx long, a double, b double, c double")
    front = {r["idx"] for r in skyline.skyline(df.repartition(4), ["a", "b", "c"]).collect()}
    want = {i for i in range(200) if not ((x >= x[i] - 1e-9).all(1) & (x > x[i] + 1e-9).any(1)).any()}
    assert front == want


def _fit_rows(fits, clusters, v=None):
    slots = scoring.SLOTS
    return [(i, v[i] if v else _unit_rows(9, 16, 5)[i][1], 0.5, 0.5, clusters[i], *f) for i, f in enumerate(fits)], "idx long, v array<double>, match double, lum01 double, cluster_id long, " + ", ".join(f"fit_{s} double" for s in slots)


def test_greedy_slots_constraints(spark):
    rows, schema = _fit_rows([[0.9] * 5] * 6, [-1] * 6)
    picked = selection.greedy_slots(spark.createDataFrame(rows, schema), scoring.SLOTS, [0.25] * 5)
    assert len({r["idx"] for r in picked}) == 5
    rows, schema = _fit_rows([[0.9] * 5] * 6, [1] * 6)
    with pytest.raises(ValueError):  # one cluster can fill one slot only
        selection.greedy_slots(spark.createDataFrame(rows, schema), scoring.SLOTS, [0.25] * 5)
    rows, schema = _fit_rows([[0.9] * 5] * 6, [-1] * 6, [[1.0, 0.0]] * 6)
    assert len(selection.greedy_slots(spark.createDataFrame(rows, schema), scoring.SLOTS, [0.25] * 5)) == 5  # similarity is relaxed
    rows, schema = _fit_rows([[0.1] * 5] * 6, [-1] * 6)
    with pytest.raises(ValueError):
        selection.greedy_slots(spark.createDataFrame(rows, schema), scoring.SLOTS, [0.25] * 5)


def test_sequences_are_unique_and_bounded(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v, float(rng.random()), *map(float, rng.random(5)), float(rng.integers(255)), float(i * 400), 0, i % 3) for i, v in _unit_rows(30, 6, 4)]
    df = spark.createDataFrame(rows, "idx long, v array<double>, score double, tech double, comp double, light double, narr double, human double, lum double, exif_ts double, faces int, event int").withColumn("personal", F.col("score"))
    assert all(len(set(r["seq"])) == 5 for r in selection.beam(df).collect())
    story = selection.story(df, 10).collect()
    assert len({r["idx"] for r in story}) == 10 and {r["role"] for r in story} == {"opener", "subject", "detail", "contrast", "closer"}
    spare = spark.createDataFrame([(9, 0.9), (3, 0.8), (8, 0.7), (1, 0.2), (2, 0.1)], "idx long, score double")
    assert selection.without_repeats(spark.createDataFrame([([3, 1, 3, 2],)], "seq array<long>"), spare).first()["seq"] == [3, 1, 9, 2]
    assert selection.portfolio(df, 5).count() == 5 and selection.story(df.limit(0)).count() == 0
    best = selection.portfolio(df, 5).first()["value"]
    assert best >= 1.0
    assert len(selection.assign_roles(df.limit(2))) == 2


def test_store_merges(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, score double")
    n = spark.createDataFrame([("b", 5.0), ("b", 7.0), ("c", 3.0)], "path string, score double")
    assert sorted(map(tuple, store.upsert(t, n).collect())) == [("a", 1.0), ("b", 7.0), ("c", 3.0)]
    assert sorted(map(tuple, store.upsert(t.limit(0), n.limit(0)).collect())) == []
    s = store.Snapshots(spark, scratch_path(spark, "snap"), t.schema)
    assert s.read().count() == 0
    s.publish(t)
    s.upsert(n)
    assert sorted(map(tuple, s.read().collect())) == [("a", 1.0), ("b", 7.0), ("c", 3.0)]
    flags = spark.createDataFrame([("a", "used")], "path string, flag string")
    assert store.toggled(flags, flags).count() == 0 and store.toggled(flags.limit(0), flags).count() == 1
    pool = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {r["path"] for r in store.rotated(pool.where("path = 'a'"), pool.where("path = 'b'"), pool).collect()} == {"b"}


def test_constraints(spark):
    with pytest.raises(ValueError):
        constraints.require_pool(spark.range(4))
    texts = {"brief": F.lit("Deserted grid at night"), "theme": F.lit("Liminal city"), "colours": F.lit("warm golden")}
    got = {n: one(spark, c) for n, c in constraints.brief_settings(texts).items()}
    assert got == {"people_wanted": "false", "sim_limit": "0.78", "tone": "warm", "hard_filter": "no people", "lighting": "low-key night", "geometric_priority": "Medium", "keywords": ["desert", "grid"]}
    assert [one(spark, constraints.slot_threshold(F.lit("x" * n))) for n in (41, 21, 0)] == [0.30, 0.25, 0.20]
    prompts = spark.createDataFrame([(1, ["melancholic", "cinematic"]), (2, [])], "key long, moods array<string>")
    roles = spark.createDataFrame([(r, *w) for r, w in selection.ROLES.items()], "role string, comp double, human double, mood double, div double")
    for r in constraints.shifted_roles(prompts, roles).collect():
        w = (r["comp"], r["human"], r["mood"], r["div"])
        assert w == selection.ROLES[r["role"]] if r["key"] == 2 else sum(w) == pytest.approx(1.0) and min(w) > 0
    assert one(spark, constraints.accept_niche(F.lit(0.9), F.lit("Street"), ["Street"])) == "Street"


def test_people_and_blur_gates(spark):
    box = F.array(F.struct(F.lit(0.4).alias("conf"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"), F.lit(50.0).alias("lum")))
    none = F.lit(None).cast(scoring._BOXES)
    assert one(spark, scoring.people_gate(box, F.lit(90.0), F.lit(50.0))) == "hard"
    assert one(spark, scoring.people_gate(none, F.lit(20.0), F.lit(10.0))) == "soft" and one(spark, scoring.people_gate(none, F.lit(90.0), F.lit(50.0))) == "pass"
    assert one(spark, scoring.sharp_enough(F.lit(None).cast("double"))) and not one(spark, scoring.sharp_enough(F.lit(3.9)))


def test_every_operator_takes_an_empty_table(spark):
    e = spark.createDataFrame([], "id long, idx long, path string, v array<double>, score double, stars int, faces int, cluster_id int, exif_ts double, label int")
    assert gallery.star_histogram(e).count() == 6 and gallery.score_statistics(e).count() == 1
    assert similarity.duplicate_groups(e).count() == similarity.duplicate_flags(e).count() == 0
    assert similarity.centroid(e, "label").count() == 0 and similarity.diversity(e).first()["worst_diversity"] == 0.5
    assert timeline.events_by_range(e).count() == 0 and selection.beam(e.withColumns({"comp": F.lit(0.0), "human": F.lit(0.0), "light": F.lit(0.0)})).count() == 0
    b = e.withColumns({k: F.lit(0.0) for k in ("tech", "comp", "light", "narr", "human")})
    assert niche.recommend(b).count() == 10


def _jpeg():
    def entry(tag, kind, n, value):
        return struct.pack("<HHI", tag, kind, n) + value

    make, model, taken = b"Canon\0", b"Canon R5\0", b"2024:05:06 07:08:09\0"
    base = 8 + 2 + 12 * 4 + 4
    exif_at = base + len(make) + len(model)
    ifd0 = struct.pack("<H", 4) + entry(271, 2, len(make), struct.pack("<I", base)) + entry(272, 2, len(model), struct.pack("<I", base + len(make))) + entry(0x8769, 4, 1, struct.pack("<I", exif_at)) + entry(274, 3, 1, struct.pack("<HH", 1, 0)) + b"\0" * 4
    extra = exif_at + 2 + 12 * 3 + 4
    sub = struct.pack("<H", 3) + entry(0x9003, 2, len(taken), struct.pack("<I", extra)) + entry(0x829D, 5, 1, struct.pack("<I", extra + len(taken))) + entry(0x8827, 3, 1, struct.pack("<HH", 400, 0)) + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd0 + make + model + sub + taken + struct.pack("<II", 28, 10)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff


def test_sources(spark, tmp_path):
    for sub, name, data in (("a", "x.JPG", _jpeg()), ("a", "y.png", b"none"), ("a", "z.txt", b""), ("b", "w.jpeg", b"\xff\xd8 broken Exif\0\0II")):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / name).write_bytes(data)
    found = files.scan(spark, [str(tmp_path / "a"), str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(r["name"] for r in files.listing(found).collect()) == ["w.jpeg", "x.JPG", "y.png"]
    assert files.scan(spark, [str(tmp_path)], recursive=True).count() == 3
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.exif(raw).collect()}
    x = got["x.JPG"]
    assert (x["camera"], x["aperture"], x["iso"], x["date"], x["time"]) == ("Canon R5", "f/2.8", "400", "2024-05-06", "07:08:09")
    assert x["exif_ts"] == 1714979289 and got["w.jpeg"]["camera"] is None and got["y.png"]["exif_ts"] == 0

    db = sqlite3.connect(tmp_path / "t.db")
    db.execute("CREATE TABLE e (path TEXT, embedding BLOB, score REAL, grade TEXT, exif_ts REAL)")
    db.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", [(f"p{i}", np.array([i, 2.0], "<f4").tobytes() if i else None, None, None, None) for i in range(25)])
    db.commit()
    rows = files.sqlite(spark, str(tmp_path / "t.db"), "e", 4).orderBy("path").collect()
    assert len(rows) == 25 and rows[0]["embedding"] is None and rows[1]["embedding"] == [1.0, 2.0] and rows[0]["grade"] == "Mid"

    df = spark.createDataFrame([("d/p", 0.5, [1.0]), ("d/q", 0.6, [1.0])], "path string, score double, embedding array<double>")
    files.write_catalog(df.limit(1), str(tmp_path / "cat"))
    files.write_catalog(df, str(tmp_path / "cat"))
    assert sorted(map(tuple, files.read_catalog(spark, str(tmp_path / "cat")).collect())) == [("d/p", 0.5), ("d/q", 0.6)]
    assert [r["folder"] for r in files.read_catalog(spark, str(tmp_path / "cat"), "folders").collect()] == ["d"]
    (tmp_path / "c.json").write_text('{"photos": [{"path": "a"}, {"path": "b"}], "saved_at": "x"}')
    assert files.catalog(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "f.json").write_text('{"locked": ["a", "b"]}')
    assert files.flags(spark, str(tmp_path / "f.json")).count() == 2


def test_stream_sessions_match_the_batch_form(spark):
    from loomwise.queries import streams, tables

    d = "/root/testdata/sf0.001"
    stream = {(r["user_id"], r["start_us"] / 1e6, r["n"]) for r in streams.stream_sessions(spark, d).collect()}
    batch = {(r["user_id"], r["start"], r["n"]) for r in tables.user_sessions(spark, d).collect()}
    assert len(stream) > 0.9 * len(batch)
    starts = {(u, int(s)) for u, s, _ in batch}
    assert sum((u, int(s)) in starts for u, s, _ in stream) > 0.98 * len(stream)
