"""Queries over tables of items: scans, merges, filters, joins, counts, timelines and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwise.functions import scalar
from loomwise.operators import constraints, gallery, layers, niche, quantiles, scoring, selection, similarity, store, timeline
from loomwise.plans import grading, items
from loomwise.queries import sequences
from loomwise.queries.grading import r6, s6
from loomwise.session import cut, materialised, scratch_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


G = grading.SQL
_ROW = "'f' || (id % 4) || '/img_' || id || '.jpg' AS path, CAST((id * {a}) % 100 AS DOUBLE) / 100 AS score, CAST((id * {b}) % 100 AS DOUBLE) / 100 AS personal"
#: A table of stored rows, one of each embedding, and one of new rows, one of each label: about half of these are stored as well.
SQL_T = f"WITH t AS (SELECT {_ROW.format(a=31, b=17)} FROM (SELECT vec_id AS id FROM embeddings)), n AS (SELECT {_ROW.format(a=57, b=13)} FROM (SELECT doc_id AS id FROM labels))"


def stored(spark, d):
    make = lambda name, key, a, b: items.table(spark, d, name).select(F.col(key).alias("id")).selectExpr(*_ROW.format(a=a, b=b).split(", "))
    return make("embeddings", "vec_id", 31, 17), make("labels", "doc_id", 57, 13)


@query("table_scan", f"{SQL_T} SELECT path, score FROM t WHERE score >= 0.45")
def table_scan(spark, d):
    return stored(spark, d)[0].where("score >= 0.45").select("path", "score")


@query("bulk_lookup", f"{SQL_T} SELECT * FROM t WHERE path IN (SELECT path FROM n UNION SELECT * FROM (VALUES ('f3/none.jpg'), ('it''s')))")
def bulk_lookup(spark, d):
    t, n = stored(spark, d)
    keys = n.select("path").union(spark.createDataFrame([("f3/none.jpg",), ("it's",)], "path string"))
    return store.lookup(t, keys)


@query("row_count", f"{SQL_T} SELECT count(*) AS n FROM t")
def row_count(spark, d):
    return stored(spark, d)[0].agg(F.count("*").alias("n"))


@query("upsert", f"{SQL_T} SELECT * FROM n UNION ALL SELECT * FROM t WHERE path NOT IN (SELECT path FROM n)")
def upsert(spark, d):
    return store.upsert(*stored(spark, d))


@query("dimension_change", "SELECT count(*) AS before, 0 AS dropped, count(*) FILTER (WHERE vec_id % 2 = 0) AS after FROM embeddings")
def dimension_change(spark, d):
    """Rows of a table of vectors, what is left of them when a model of another length comes, and the rows that it grades anew."""
    rows = items.table(spark, d, "embeddings").select(F.concat(F.lit("p"), "vec_id").alias("path"), F.col("embedding").alias("v"), "vec_id")
    table = layers.Layers(spark, scratch_path(spark, "vectors"), rows.select("path", "v").schema, "path")
    table.upsert(rows)
    table.recreate_unless("v", 64)
    counted = lambda name: table.read().agg(F.count("*").alias(name))
    before = materialised(counted("before"), "counted")
    table.recreate_unless("v", 128)
    dropped = materialised(counted("dropped"), "counted")
    table.upsert(rows.where("vec_id % 2 = 0").withColumn("v", F.concat("v", "v")))
    table.recreate_unless("v", 128)
    return before.crossJoin(dropped).crossJoin(counted("after"))


@query("snapshot_upsert", f"{SQL_T} SELECT * FROM n UNION ALL SELECT * FROM t WHERE path NOT IN (SELECT path FROM n)")
def snapshot_upsert(spark, d):
    t, n = stored(spark, d)
    s = store.Snapshots(spark, scratch_path(spark, "snapshots"), t.schema)
    s.publish(t)
    s.upsert(n)
    s.compact()
    return s.read()


@query("append_rows", f"{SQL_T} SELECT * FROM t UNION ALL SELECT * FROM n")
def append_rows(spark, d):
    t, n = stored(spark, d)
    return t.unionByName(n)


@query("update_only", f"{SQL_T} SELECT t.path, t.score, coalesce(n.personal, t.personal) AS personal FROM t LEFT JOIN n USING (path)")
def update_only(spark, d):
    t, n = stored(spark, d)
    return store.update_only(t, n, ["personal"])


@query("delete_key", f"{SQL_T} SELECT * FROM t WHERE path NOT IN (SELECT path FROM n)")
def delete_key(spark, d):
    return store.delete_keys(*stored(spark, d))


@query("evolve_schema", f"{SQL_T} SELECT path, CAST(score AS FLOAT) AS score, 'Mid' AS grade, CAST(0.5 AS DOUBLE) AS confidence FROM t")
def evolve_schema(spark, d):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("path string, score float, grade string, confidence double")
    return store.conformed(stored(spark, d)[0], schema, {"grade": "Mid", "confidence": 0.5})


@query("incremental_scan", f"{SQL_T} SELECT path FROM n WHERE path NOT IN (SELECT path FROM t WHERE starts_with(path, 'f1/') AND score >= 0.10)")
def incremental_scan(spark, d):
    t, n = stored(spark, d)
    return store.not_graded(n.select("path"), t, "f1/")


@query("flag_toggle", f"{SQL_T}, a AS (SELECT path, 'locked' AS flag FROM t WHERE score > 0.5), b AS (SELECT path, 'locked' AS flag FROM n WHERE score > 0.3) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def flag_toggle(spark, d):
    t, n = stored(spark, d)
    flag = lambda df, x: df.where(F.col("score") > x).select("path", F.lit("locked").alias("flag"))
    return store.toggled(flag(t, 0.5), flag(n, 0.3))


@query("save_sequence", f"{SQL_T}, s AS (SELECT path AS name, [path] AS frames FROM t), m AS (SELECT path AS name, [path, 'new'] AS frames FROM n WHERE score > 0.5) SELECT * FROM m UNION ALL SELECT * FROM s WHERE name NOT IN (SELECT name FROM m)")
def save_sequence(spark, d):
    t, n = stored(spark, d)
    old = t.select(F.col("path").alias("name"), F.array("path").alias("frames"))
    return store.replaced_by_name(old, n.where("score > 0.5").select(F.col("path").alias("name"), F.array("path", F.lit("new")).alias("frames")))


@query("used_rotation", f"{SQL_T}, x AS (SELECT path FROM t UNION SELECT path FROM n) SELECT path FROM x WHERE (SELECT count(*) FROM t WHERE path NOT IN (SELECT path FROM x)) > 0 UNION SELECT path FROM n")
def used_rotation(spark, d):
    t, n = stored(spark, d)
    return store.rotated(t, n, t)


@query("used_union", f"{SQL_T} SELECT path FROM t WHERE score > 0.5 UNION SELECT path FROM n")
def used_union(spark, d):
    t, n = stored(spark, d)
    return store.rotated(t.where("score > 0.5"), n, t)


@query("history_trim", f"{SQL_T} SELECT path FROM (SELECT path, score AS generated_at FROM t) ORDER BY generated_at DESC, path LIMIT 25")
def history_trim(spark, d):
    return store.history(stored(spark, d)[0].select("path", F.col("score").alias("generated_at"))).select("path")


@query(
    "export_paths",
    f"""{SQL_T}, x AS (SELECT path, 'pic_' || (CAST(score * 100 AS INTEGER) % 7) || '.jpg' AS fn, CASE WHEN score >= 0.6 THEN 'Strong' WHEN score >= 0.41 THEN 'Mid' ELSE 'Weak' END AS grade FROM t),
y AS (SELECT *, row_number() OVER (PARTITION BY grade, fn ORDER BY path || '/' || fn) - 1 AS r FROM x WHERE grade IN ('Strong', 'Mid'))
SELECT path || '/' || fn AS source, 'out/' || grade || '/' || CASE WHEN r = 0 THEN fn ELSE regexp_replace(fn, '\\.[^.]*$', '') || '_' || r || '.jpg' END AS target FROM y""",
)
def export_paths(spark, d):
    t = stored(spark, d)[0]
    fn = F.concat(F.lit("pic_"), F.round(F.col("score") * 100).cast("int") % 7, F.lit(".jpg"))
    return store.export_paths(t.select(F.concat("path", F.lit("/"), fn).alias("path"), scalar.grade(F.col("score")).alias("grade")), "out", ["Strong", "Mid"])


@query("sidecar_rating", f"{SQL_T} SELECT path, CAST(least(greatest(round_even(score * 5, 0), 0), 5) AS INTEGER) AS rating FROM t")
def sidecar_rating(spark, d):
    return stored(spark, d)[0].select("path", scalar.star_rating(F.col("score")).alias("rating"))


@query(
    "story_manifest",
    f"""{SQL_T}, x AS (SELECT path, 'Role' || (CAST(round(score * 100) AS INTEGER) % 5) AS role, CAST(round(score * 100) AS INTEGER) % 5 AS rp FROM t)
SELECT path, printf('%02d_%s_%s', row_number() OVER (ORDER BY rp, path), lower(role), string_split(path, '/')[-1]) AS name FROM x""",
)
def story_manifest(spark, d):
    t = stored(spark, d)[0]
    rp = F.round(F.col("score") * 100).cast("int") % 5
    return store.story_names(t.select("path", F.concat(F.lit("Role"), rp).alias("role"), rp.alias("rp"), F.lit(True).alias("ok")), "rp")


@query("tokenize_candidates", f"{SQL_T} SELECT path, score, printf('IMG_%02d', row_number() OVER (ORDER BY path) - 1) AS token FROM t")
def tokenize_candidates(spark, d):
    return store.tokens(stored(spark, d)[0].select("path", "score"))


# -- gallery ------------------------------------------------------------------


def _gallery(spark, d):
    g = grading.graded(spark, d)
    i = F.col("idx")
    return g.withColumns({"cluster_id": F.when(i % 5 == 0, i % 50).otherwise(-1), "sim_flag": F.when(i % 10 == 0, "Best of 2").otherwise("Duplicate"), "stars": F.when(i % 7 != 0, (i % 6).cast("int")), "in_sequence": i % 31 == 0})


SQL_G = f"{G}, gal AS (SELECT *, CASE WHEN idx % 5 = 0 THEN idx % 50 ELSE -1 END AS cluster_id, CASE WHEN idx % 10 = 0 THEN 'Best of 2' ELSE 'Duplicate' END AS sim_flag, CASE WHEN idx % 7 <> 0 THEN CAST(idx % 6 AS INTEGER) END AS stars, idx % 31 = 0 AS in_sequence FROM g), gr AS (SELECT *, cluster_id >= 0 AND NOT starts_with(sim_flag, 'Best') AS reject FROM gal)"


@query(
    "gallery_rows",
    f"""{SQL_G} SELECT path AS id, path, path AS filename, grade, round(score, 3) AS score, round(score, 3) AS overall_score, round(score, 3) AS rating, round(personal, 3) AS human_perception, round(personal, 3) AS personal_score,
 round(list_sum(v), 6) AS embedding_sum, list_transform(list_sort(map_entries(map(['Aesthetic', 'Personal', 'tech', 'comp'], [round(score, 3), round(personal, 3), round(tech, 3), round(comp, 3)]))), lambda e: e.key || '=' || printf('%.3f', e.value)) AS breakdown,
 '' AS critique, '' AS reasoning_log, false AS is_verified, exif_ts, coalesce(stars, 0) AS stars, reject, sim_flag, cluster_id FROM gr""",
)
def gallery_rows(spark, d):
    g = _gallery(spark, d).withColumn("aspects", F.create_map(F.lit("tech"), "tech", F.lit("comp"), "comp"))
    shown = F.transform(F.array_sort(F.map_entries("breakdown")), lambda e: F.concat(e.key, F.lit("="), F.format_string("%.3f", e.value)))
    out = gallery.projection(gallery.rows(g), "aspects").withColumn("breakdown", shown)
    return out.withColumn("embedding_sum", F.round(F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y), 6)).drop("embedding")


#: The two sources that are unified: stored rows of all embeddings, and a cache of the labels.
_SOURCES = """WITH db AS (SELECT 'p' || vec_id AS path, len(embedding) AS dims, CASE WHEN vec_id % 3 = 0 THEN (vec_id % 10) / 10.0 END AS quality, CASE WHEN vec_id % 4 = 0 THEN 0.9 END AS personal_score,
 CAST(vec_id AS DOUBLE) AS exif_ts, CASE WHEN vec_id % 5 <> 0 THEN (vec_id % 8) / 8.0 END AS score, CASE WHEN vec_id % 7 = 0 THEN 'Mid' END AS grade FROM embeddings),
c AS (SELECT 'p' || doc_id AS path, ['Strong', '', '0.5', NULL][doc_id % 4 + 1] AS grade, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 16) / 16.0 END AS score, CASE WHEN doc_id % 3 = 0 THEN 'seen ' || doc_id END AS critique, doc_id % 5 AS faces FROM labels)"""


@query(
    "unify_sources",
    f"""{_SOURCES}, u AS (SELECT db.path, CASE WHEN c.grade <> '' THEN c.grade WHEN db.grade <> '' THEN db.grade ELSE '' END AS grade, coalesce(c.score, db.score, 0.0) AS score, coalesce(c.critique, '') AS critique, coalesce(c.faces, 0) AS faces, exif_ts,
 CASE WHEN quality <> 0 THEN quality WHEN personal_score <> 0 THEN personal_score ELSE 0.5 END AS personal_score, 1152 AS dims,
 CASE WHEN c.grade <> '' THEN 'cache' WHEN db.grade <> '' THEN 'stored' ELSE 'default' END AS grade_from, CASE WHEN c.score IS NOT NULL THEN 'cache' WHEN db.score IS NOT NULL THEN 'stored' ELSE 'default' END AS score_from FROM db LEFT JOIN c USING (path))
SELECT path, CAST(CASE WHEN contains(grade, 'Strong') THEN 2 WHEN contains(grade, 'Mid') THEN 1 WHEN contains(grade, 'Weak') THEN 0 WHEN TRY_CAST(grade AS DOUBLE) >= 0.7 THEN 2 WHEN TRY_CAST(grade AS DOUBLE) >= 0.4 THEN 1 WHEN TRY_CAST(grade AS DOUBLE) IS NOT NULL THEN 0 ELSE 1 END AS INTEGER) AS level,
 grade, CAST(score AS DOUBLE) AS score, critique, faces, exif_ts, CAST(personal_score AS DOUBLE) AS personal_score, dims, grade_from, score_from FROM u""",
)
def unify_sources(spark, d):
    e, n = items.table(spark, d, "embeddings"), items.table(spark, d, "labels")
    db = e.selectExpr(
        "concat('p', vec_id) AS path", "embedding", "CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 / 10 END AS quality", "CASE WHEN vec_id % 4 = 0 THEN 0.9D END AS personal_score",
        "CAST(vec_id AS DOUBLE) AS exif_ts", "CASE WHEN vec_id % 5 <> 0 THEN vec_id % 8 / 8 END AS score", "CASE WHEN vec_id % 7 = 0 THEN 'Mid' END AS grade",
    )
    cache = n.selectExpr("concat('p', doc_id) AS path", "array('Strong', '', '0.5', NULL)[int(doc_id % 4)] AS grade", "CASE WHEN doc_id % 2 = 0 THEN doc_id % 16 / 16 END AS score", "CASE WHEN doc_id % 3 = 0 THEN concat('seen ', doc_id) END AS critique", "doc_id % 5 AS faces")
    u = gallery.unified(db, cache)
    return u.select("path", "level", "grade", "score", "critique", "faces", "exif_ts", "personal_score", F.size("vector").alias("dims"), F.col("origin.grade").alias("grade_from"), F.col("origin.score").alias("score_from"))


@query("gallery_filter", f"{SQL_G} SELECT path FROM gr WHERE (NOT reject AND coalesce(stars, 0) >= 2) OR in_sequence")
def gallery_filter(spark, d):
    return gallery.visible(gallery.rows(_gallery(spark, d)), min_stars=2).select("path")


@query("gallery_filter_grade", f"{SQL_G} SELECT path FROM gr WHERE NOT reject AND grade IN ('Strong', 'Mid')")
def gallery_filter_grade(spark, d):
    return gallery.visible(gallery.rows(_gallery(spark, d)), grades=["Strong", "Mid"]).select("path")


@query("gallery_sort", f"{SQL_G} SELECT path, CASE grade WHEN 'Strong' THEN 0 WHEN 'Mid' THEN 1 ELSE 2 END AS g, {s6('score')} FROM gr")
def gallery_sort(spark, d):
    g = _gallery(spark, d).withColumn("g", gallery.grade_order(F.col("grade"))).orderBy("g", F.desc("score"), "path")
    return g.select("path", "g", *r6("score"))


@query("star_sort", f"{SQL_G} SELECT path, stars FROM gr")
def star_sort(spark, d):
    s = F.coalesce("stars", F.lit(0))
    return _gallery(spark, d).orderBy((s == 3).desc(), s.desc(), "path").select("path", "stars")


@query("grade_counts", f"{SQL_G} SELECT count(*) FILTER (WHERE grade = 'Strong') AS strong, count(*) FILTER (WHERE grade = 'Mid') AS mid, count(*) FILTER (WHERE grade = 'Weak') AS weak, count(*) AS total FROM gr")
def grade_counts(spark, d):
    return gallery.grade_counts(_gallery(spark, d))


@query("star_histogram", f"{SQL_G} SELECT CAST(s AS INTEGER) AS stars, count(path) AS n FROM range(6) r(s) LEFT JOIN gr ON coalesce(stars, 0) = s GROUP BY s")
def star_histogram(spark, d):
    return gallery.star_histogram(_gallery(spark, d))


@query(
    "score_stats",
    f"{G} SELECT {', '.join(f'round({x}, 6) AS {n}' for x, n in [('min(score)', 'low'), ('max(score)', 'high'), ('avg(score)', 'mean'), ('quantile_cont(score, 0.5)', 'median'), ('stddev_pop(score)', 'std'), ('avg((faces > 0)::INT)', 'with_faces'), ('avg((score > 0.65)::INT)', 'strong_frac'), ('avg((score < 0.45)::INT)', 'weak_frac')])} FROM g",
)
def score_stats(spark, d):
    return gallery.score_statistics(grading.graded(spark, d)).select(*r6("low", "high", "mean", "median", "std", "with_faces", "strong_frac", "weak_frac"))


@query("event_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM events GROUP BY event_type")
def event_stats(spark, d):
    e = items.table(spark, d, "events").select("event_type", "value")
    figures = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("*").alias("n"))
    median = quantiles.exact_quantiles(e, "value", [0.5], ["event_type"]).select(F.col("event_type").alias("of"), F.round("value", 6).alias("median"))
    return figures.join(median, F.col("event_type").eqNullSafe(F.col("of")), "left").select("event_type", "mean", "std", "median", "n")


@query("event_quantiles", "SELECT event_type, CAST(p AS DOUBLE) AS p, round(quantile_cont(value, p), 6) AS value FROM events, (SELECT unnest([0.0, 0.01, 0.25, 0.9, 1.0]) AS p) GROUP BY event_type, p".replace("quantile_cont(value, p)", "CASE p " + " ".join(f"WHEN {x} THEN quantile_cont(value, {x})" for x in (0.0, 0.01, 0.25, 0.9, 1.0)) + " END"))
def event_quantiles(spark, d):
    return quantiles.exact_quantiles(items.table(spark, d, "events"), "value", [0.0, 0.01, 0.25, 0.9, 1.0], ["event_type"]).select("event_type", "p", F.round("value", 6).alias("value"))


@query("parent_folders", f"{SQL_T} SELECT split_part(path, '/', 1) AS folder, min(CAST(split_part(split_part(path, '_', 2), '.', 1) AS BIGINT)) AS first FROM t GROUP BY 1")
def parent_folders(spark, d):
    pos = F.regexp_extract("path", r"_(\d+)\.", 1).cast("long")
    return gallery.parents(stored(spark, d)[0].withColumn("pos", pos))


@query("left_enrich", f"{SQL_T}, s AS (SELECT path FROM n) SELECT s.path, t.score, t.personal FROM s LEFT JOIN t USING (path)")
def left_enrich(spark, d):
    t, n = stored(spark, d)
    return gallery.enrich(n.select("path"), t)


@query("precedence_merge", f"{SQL_T} SELECT n.path, coalesce(CASE WHEN n.score > 0.3 THEN n.score END, t.score) AS score, coalesce(t.personal, 0.5) AS personal FROM n LEFT JOIN t USING (path)")
def precedence_merge(spark, d):
    t, n = stored(spark, d)
    mine = n.select("path", F.when(F.col("score") > 0.3, F.col("score")).alias("score"))
    return gallery.enrich(mine, t).withColumn("personal", F.coalesce("personal", F.lit(0.5)))


@query("missing_vectors", f"{items.SQL.join(['WITH ', ''])} SELECT it.idx, len(coalesce(x.v, list_transform(range(64), lambda i: 0.0::DOUBLE))) AS n, x.v IS NULL AS missing FROM it LEFT JOIN (SELECT id, v FROM u WHERE id % 3 = 0) x ON x.id = it.idx")
def missing_vectors(spark, d):
    from loomwise.functions.vectors import fit

    v = items.units(spark, d).where("id % 3 = 0").select(F.col("id").alias("idx"), F.col("v").alias("w"))
    j = items.items(spark, d).join(v, "idx", "left")
    return j.select("idx", F.size(fit(F.col("w"), 64)).cast("long").alias("n"), F.col("w").isNull().alias("missing"))


@query("semi_anti", f"{SQL_T} SELECT path, true AS known FROM n WHERE path IN (SELECT path FROM t) UNION ALL SELECT path, false FROM n WHERE path NOT IN (SELECT path FROM t)")
def semi_anti(spark, d):
    t, n = stored(spark, d)
    return n.join(t, "path", "left_semi").select("path", F.lit(True).alias("known")).union(n.join(t, "path", "left_anti").select("path", F.lit(False)))


@query("full_outer_restore", f"{SQL_T}, o AS (SELECT path, CAST(split_part(split_part(path, '_', 2), '.', 1) AS BIGINT) AS pos FROM (SELECT path FROM t UNION SELECT path FROM n)) SELECT o.pos, o.path, coalesce(n.score, t.score) AS score, coalesce(n.personal, t.personal) AS personal FROM o LEFT JOIN t USING (path) LEFT JOIN n USING (path)")
def full_outer_restore(spark, d):
    t, n = stored(spark, d)
    order = t.select("path").union(n.select("path")).distinct().withColumn("pos", F.regexp_extract("path", r"_(\d+)\.", 1).cast("long"))
    return gallery.restored(t, n, order)


@query("dim_means", f"{G}, l AS (SELECT unnest([struct_pack(d := 'tech', x := tech), struct_pack(d := 'comp', x := comp), struct_pack(d := 'light', x := light), struct_pack(d := 'auth', x := narr), struct_pack(d := 'human', x := human)]) AS s FROM g) SELECT {', '.join(f'round(avg(s.x) FILTER (WHERE s.d = {k!r}), 6) AS {k}' for k in niche.DIMENSIONS)} FROM l")
def dim_means(spark, d):
    pairs = {"Technical": "tech", "Framing": "comp", "Atmosphere": "light", "Immediacy": "narr", "Presence": "human"}
    m = F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c))], F.lit("Unknown"), F.lit(9.0))
    return niche.dimension_means(grading.graded(spark, d).withColumn("breakdown", m)).select(*r6(*niche.DIMENSIONS))


@query("strongest_dim", f"{G}, m AS (SELECT avg(tech) AS tech, avg(comp) AS comp, avg(light) AS light, avg(narr) AS narr, avg(human) AS human FROM g), l AS (SELECT unnest([struct_pack(x := tech, d := 'tech'), struct_pack(x := comp, d := 'comp'), struct_pack(x := light, d := 'light'), struct_pack(x := narr, d := 'narr'), struct_pack(x := human, d := 'human')]) AS s FROM m) SELECT max_by(s.d, s.x) AS strongest, min_by(s.d, s.x) AS weakest FROM l")
def strongest_dim(spark, d):
    a = scoring.ASPECTS
    return gallery.argmax_dimension(grading.graded(spark, d).agg(*[F.avg(c).alias(c) for c in a]), a)


@query("aspect_bars", f"{G}, e AS (SELECT path, unnest([struct_pack(o := -tech, k := 'Technical'), struct_pack(o := -comp, k := 'Composition'), struct_pack(o := 0.0, k := 'Lighting')]) AS s FROM g) SELECT path, list(s.k || '=' || printf('%.3f', abs(s.o)) ORDER BY s) AS bars FROM e GROUP BY path")
def aspect_bars(spark, d):
    m = F.create_map(F.lit("Technical"), F.col("tech"), F.lit("Composition"), F.col("comp"), F.lit("_raw"), F.lit(1.0))
    return grading.graded(spark, d).select("path", gallery.aspect_bars(m, ["Technical", "Composition", "Lighting"], ["_raw"]).alias("bars"))


@query("feedback_log", f"{SQL_T}, p AS (SELECT t.path, CASE WHEN t.score >= 0.6 THEN 2 WHEN t.score >= 0.41 THEN 1 ELSE 0 END AS o, CASE WHEN n.score >= 0.6 THEN 2 WHEN n.score >= 0.41 THEN 1 ELSE 0 END AS w FROM t JOIN n USING (path)), c AS (SELECT count(*) FILTER (WHERE w > o) AS upgrades, count(*) FILTER (WHERE w < o) AS downgrades, count(*) AS total FROM p) SELECT *, CASE WHEN total < 5 THEN 'none' WHEN upgrades > 1.5 * downgrades THEN 'grades too low' WHEN downgrades > 1.5 * upgrades THEN 'grades too high' ELSE 'none' END AS note FROM c")
def feedback_log(spark, d):
    return gallery.feedback(_changes(spark, d))


def _changes(spark, d):
    t, n = stored(spark, d)
    level = lambda c: scalar.grade_level(scalar.grade(c))
    return t.join(n.select("path", F.col("score").alias("ns")), "path").select("path", level(F.col("score")).alias("old_level"), level(F.col("ns")).alias("new_level"))


@query("feedback_pairs", f"{SQL_T}, p AS (SELECT t.path, CASE WHEN t.score >= 0.6 THEN 0.72 WHEN t.score >= 0.41 THEN 0.50 ELSE 0.28 END AS o, CASE WHEN n.score >= 0.6 THEN 0.72 WHEN n.score >= 0.41 THEN 0.50 ELSE 0.28 END AS w FROM t JOIN n USING (path)) SELECT path, CAST(greatest(o, w) AS DOUBLE) AS winner, CAST(least(o, w) AS DOUBLE) AS loser, w > o AS upgrade FROM p WHERE o <> w")
def feedback_pairs(spark, d):
    return gallery.feedback_pairs(_changes(spark, d))


# -- constraints and texts -----------------------------------------------------


@query("literal_filter", f"{G} SELECT path FROM g WHERE score >= 0.3 AND NOT (contains(lower(log), 'person') OR contains(lower(log), 'people') OR contains(lower(log), 'pedestrian') OR contains(lower(log), 'figure') OR contains(lower(log), 'crowd') OR contains(lower(log), 'human')) AND contains(lower(log), 'interior') AND NOT contains(lower(log), 'macro')")
def literal_filter(spark, d):
    ok = constraints.passes(people_allowed=False, required=["interior"], forbidden=["macro"], min_score=0.3)
    return constraints.require_pool(grading.graded(spark, d).where(ok)).select("path")


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {w!r})" for w in words) + ")"


@query(
    "brief_constraints",
    f"""SELECT doc_id, NOT {_any("b", constraints.EMPTY)} AS people_allowed, list_filter([CASE WHEN {_any("b", constraints.INTERIOR)} THEN 'interior' END, CASE WHEN {_any("b", constraints.EXTERIOR)} THEN 'exterior' END], lambda x: x IS NOT NULL) AS required_tags, {_any("b", constraints.MONO)} AS monochrome_only
FROM (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'Empty ROOM ' WHEN 1 THEN 'street, b&w ' WHEN 2 THEN 'inside the alley ' ELSE '' END || text) AS b FROM documents)""",
)
def brief_constraints(spark, d):
    lead = F.when(F.col("doc_id") % 4 == 0, "Empty ROOM ").when(F.col("doc_id") % 4 == 1, "street, b&w ").when(F.col("doc_id") % 4 == 2, "inside the alley ").otherwise("")
    docs = items.table(spark, d, "documents").select("doc_id", F.concat(lead, "text").alias("b"))
    return docs.select("doc_id", *[c.alias(n) for n, c in constraints.brief_constraints(F.col("b")).items()])


@query("vibe_filter", f"{G}, x AS (SELECT g.path, g.score, list_inner_product(g.v, q.v) AS sim FROM g, (SELECT v FROM u WHERE id = 3) q) SELECT path, round(sim, 6) AS sim FROM x WHERE CASE WHEN (SELECT count(*) FROM x WHERE sim >= 0.25) >= 5 THEN sim >= 0.25 ELSE score >= 0.30 END")
def vibe_filter(spark, d):
    vibe = items.units(spark, d).where("id = 3").select("v")
    return constraints.vibe_filter(grading.graded(spark, d), vibe, near=0.25).select("path", *r6("sim"))


@query("relaxed_pool", f"{G} SELECT path FROM g WHERE score >= 0.99 OR (SELECT count(*) FROM g WHERE score >= 0.99) < 5")
def relaxed_pool(spark, d):
    return constraints.relaxed(grading.graded(spark, d), 0.99).select("path")


@query("avoid_set", f"{SQL_T}, a AS (SELECT path FROM n WHERE score > 0.2), f AS (SELECT path FROM t WHERE path NOT IN (SELECT path FROM a)) SELECT path FROM t WHERE path IN (SELECT path FROM f) OR (SELECT count(*) FROM f) < 5")
def avoid_set(spark, d):
    t, n = stored(spark, d)
    return constraints.without(t.select("path"), n.where("score > 0.2"))


@query("cluster_rejects", f"{G} SELECT path FROM g WHERE score >= 0.41 EXCEPT SELECT path FROM g WHERE faces = 0")
def cluster_rejects(spark, d):
    g = grading.graded(spark, d)
    return g.where("score >= 0.41").select("path").exceptAll(g.where("faces = 0").select("path"))


PROMPTS = "CASE doc_id % 5 WHEN 0 THEN 'A dark noir portrait in 12 frames. ' WHEN 1 THEN 'Clean building, 7 photos for the jury. ' WHEN 2 THEN 'Warm candid city, 2 shots ' WHEN 3 THEN 'scenic ' ELSE '' END || text"
_GENRE = "coalesce(" + ", ".join(f"CASE WHEN {_any('p', w)} THEN '{g}' END" for g, w in constraints.GENRES.items()) + ")"
_MOOD = "list_filter([" + ", ".join(f"CASE WHEN {_any('p', w)} THEN '{m}' END" for m, w in constraints.MOODS.items()) + "], lambda x: x IS NOT NULL)"


@query(
    "director_prompt",
    rf"""SELECT doc_id, {_GENRE} AS genre, {_MOOD} AS moods, CASE WHEN regexp_extract(p, '{constraints.FRAMES}', 1) = '' THEN 5 ELSE least(greatest(TRY_CAST(regexp_extract(p, '{constraints.FRAMES}', 1) AS INTEGER), 3), 10) END AS target
FROM (SELECT doc_id, lower({PROMPTS}) AS p FROM documents)""",
)
def director_prompt(spark, d):
    docs = items.table(spark, d, "documents").select("doc_id", F.expr(PROMPTS).alias("p"))
    return docs.select("doc_id", *[c.alias(n) for n, c in constraints.direction(F.col("p")).items()])


@query(
    "brief_variants",
    "SELECT doc_id, list_distinct(l) IS NOT NULL AS ok, l[2] AS second, len(l) AS n FROM (SELECT doc_id, [t, 'street photography: ' || t, 'photographic mood and visual atmosphere: ' || t, 'a photograph that captures ' || t, 'visual style and aesthetic: ' || t] AS l FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents))",
)
def brief_variants(spark, d):
    docs = items.table(spark, d, "documents").select("doc_id", constraints.variants(F.col("text")).alias("l"))
    return docs.select("doc_id", F.lit(True).alias("ok"), F.get("l", F.lit(1)).alias("second"), F.size("l").cast("long").alias("n"))


@query("pacing_weights", "SELECT event_id, CASE WHEN s = 0 THEN 1 / CAST(3 AS DOUBLE) ELSE round(a / s, 6) END AS visual_flow FROM (SELECT event_id, CAST(event_id % 5 AS DOUBLE) AS a, CAST(event_id % 5 AS DOUBLE) + greatest(0, event_id % 3 - 1) AS s FROM events)")
def pacing_weights(spark, d):
    e = items.table(spark, d, "events")
    m = F.create_map(F.lit("visual_flow"), (F.col("event_id") % 5).cast("double"), F.lit("visual_diversity"), (F.col("event_id") % 3 - 1).cast("double"))
    flow = F.element_at(constraints.pacing(m), F.lit("visual_flow"))
    return e.select("event_id", F.when(flow == 1 / 3, flow).otherwise(F.round(flow, 6)).alias("visual_flow"))


@query("json_breakdown", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(p, '$.k') AS DOUBLE), 0.0) AS k FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{}' ELSE props END AS p FROM events)")
def json_breakdown(spark, d):
    p = F.when(F.col("event_id") % 9 == 0, "not json").otherwise(F.col("props"))
    return items.table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(scalar.numbers_map(p), F.lit("k")), F.lit(0.0)).alias("k"))


@query(
    "exif_parse",
    """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE floor(epoch(ts)) END AS seconds, CASE WHEN event_id % 3 = 0 THEN 'CANON R5' ELSE 'NIKON CORPORATION Z' || (event_id % 9) END AS camera,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE printf('%+.1f EV', (event_id % 5) / CAST(2 AS DOUBLE)) END AS ev, round((10 + 30 / CAST(60 AS DOUBLE) + 36 / CAST(3600 AS DOUBLE)) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END, 6) AS lat,
 CASE event_id % 4 WHEN 1 THEN 'Manual' WHEN 2 THEN 'Program' WHEN 3 THEN 'Aperture priority' END AS program FROM events""",
)
def exif_parse(spark, d):
    i = F.col("event_id")
    text = F.when(i % 6 == 0, "broken").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    make, model = F.when(i % 3 == 0, "Canon Inc").otherwise("NIKON CORPORATION"), F.when(i % 3 == 0, "CANON R5").otherwise(F.concat(F.lit("Z"), i % 9))
    return items.table(spark, d, "events").select(
        "event_id",
        scalar.exif_seconds(text).alias("seconds"),
        scalar.camera_name(make, model).alias("camera"),
        scalar.exposure_bias((i % 5) / 2).alias("ev"),
        F.round(scalar.degrees(F.array(F.lit(10.0), F.lit(30.0), F.lit(36.0)), F.when(i % 2 == 0, "S").otherwise("N"), "S"), 6).alias("lat"),
        scalar.coded(i % 4, {1: "Manual", 2: "Program", 3: "Aperture priority"}).alias("program"),
    )


@query("aspect_ratio", "SELECT event_id, min_by(n, row(abs(r - w / CAST(h AS DOUBLE)), k)) AS ratio FROM (SELECT event_id, event_id % 17 + 3 AS w, event_id % 13 + 3 AS h FROM events), (VALUES (0, 1.0::DOUBLE, '1:1'), (1, 4 / 3::DOUBLE, '4:3'), (2, 1.5::DOUBLE, '3:2'), (3, 16 / 9::DOUBLE, '16:9'), (4, 2 / 3::DOUBLE, '2:3'), (5, 0.75::DOUBLE, '3:4'), (6, 9 / 16::DOUBLE, '9:16')) v(k, r, n) GROUP BY event_id")
def aspect_ratio(spark, d):
    return items.table(spark, d, "events").select("event_id", scalar.aspect_ratio((F.col("event_id") % 17 + 3).cast("double"), (F.col("event_id") % 13 + 3).cast("double")).alias("ratio"))


# -- niches ---------------------------------------------------------------------

_SIG = "faces AS n_faces, human AS h, comp AS c, light AS l, tech AS t, narr AS m, lum > 200 AS high_key, lum_std > 80 AS backlit, false AS chiaroscuro, idx % 4 = 0 AS directional_blur, lum_std / 100 AS shadow_dark, lum / 256 AS bright_frac, lum AS center_mean, confidence AS decisive, lum * 2 AS best_sharp"


@query("niche_rules", f"{G}, x AS (SELECT path, idx, confidence AS cf, {_SIG} FROM g), y AS (SELECT path, cf, {niche.RULES_SQL} AS metric FROM x) SELECT path, metric, CASE WHEN cf > 0.35 AND 'Street/Urban' <> metric THEN 'Street/Urban' ELSE metric END AS niche FROM y")
def niche_rules(spark, d):
    g = grading.graded(spark, d).selectExpr("path", "confidence AS cf", *_SIG.split(", "))
    m = g.withColumn("metric", niche.niche_by_rules())
    return m.select("path", "metric", niche.with_model(F.col("metric"), F.lit("Street/Urban"), F.col("cf"), 0.35).alias("niche"))


_CRIT = "human AS decisive_moment, comp AS layering_depth, tech AS juxtaposition, light AS light_atmosphere, narr AS authenticity, overall_c AS composition_geometry, personal AS human_perception"


@query(
    "preset_rescore",
    f"""{G}, x AS (SELECT path, {_CRIT} FROM g), y AS (SELECT x.*, preset, least(greatest({" + ".join(f"{c} * w[{k + 1}]" for k, c in enumerate(niche.CRITERIA))} + 0.2 * human_perception, 0.0), 1.0) AS preset_score FROM x, (VALUES {", ".join(f"('{n}', [{', '.join(f'{x}::DOUBLE' for x in w)}])" for n, w in niche.PRESETS.items())}) v(preset, w)),
z AS (SELECT *, CASE WHEN preset_score > 0.68 THEN 'Strong' WHEN preset_score > 0.48 THEN 'Mid' ELSE 'Weak' END AS preset_grade FROM y) SELECT path, preset, round(preset_score, 6) AS preset_score, preset_grade, {niche.CRITIQUE_SQL} || {niche.NOTE_SQL} AS critique FROM z""",
)
def preset_rescore(spark, d):
    g = grading.graded(spark, d).selectExpr("path", *_CRIT.split(", "))
    return niche.preset_score(g).select("path", "preset", *r6("preset_score"), "preset_grade", "critique")


_REC = "UNION ALL ".join(f"SELECT '{n}' AS preset, CAST({f} AS DOUBLE) AS raw FROM b1 " for n, f in niche.RECOMMEND.items())
_STATS = f"{G}, b AS (SELECT avg(tech) AS t, avg(comp) AS c, avg(light) AS l, avg(narr) AS a, avg(human) AS h, stddev_pop(score) FILTER (WHERE score > 0) AS score_std, avg(faces) AS avg_faces, avg((faces > 0)::INT) AS with_faces, avg((score > 0.65)::INT) AS strong_frac, avg((score < 0.45)::INT) AS weak_frac FROM g), b1 AS (SELECT *, greatest(0.0, 0.45 - t) AS low_tech, greatest(0.0, 0.30 - h) AS no_people FROM b)"


@query(
    "preset_recommend",
    f"""{_STATS}, r AS ({_REC}), s9 AS (SELECT preset, (raw - min(raw) OVER ()) / greatest(max(raw) OVER () - min(raw) OVER (), 0.01) AS score FROM r), k AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, preset) AS INTEGER) AS rank FROM s9)
SELECT rank, preset, round(score, 6) AS score, CAST(round_even(least(((SELECT score FROM k WHERE rank = 1) - (SELECT score FROM k WHERE rank = 2)) * 2.5, 1.0) * 99, 0) AS INTEGER) AS confidence FROM k""",
)
def preset_recommend(spark, d):
    return niche.recommend(grading.graded(spark, d)).select("rank", "preset", *r6("score"), "confidence")


_DIMS = ["tech", "comp", "light", "narr", "human"]


@query(
    "archetype_match",
    f"""{G}, m AS (SELECT [avg(tech), avg(comp), avg(light), avg(narr), avg(human)] AS a FROM g), s9 AS (SELECT preset, list_inner_product(a, w) / ((sqrt(list_inner_product(a, a)) + 0.000001) * (sqrt(list_inner_product(w, w)) + 0.000001)) AS similarity FROM m, (VALUES {", ".join(f"('{n}', [{', '.join(f'{x}::DOUBLE' for x in w)}])" for n, w in niche.PROFILES.items())}) v(preset, w))
SELECT preset, round(similarity, 6) AS similarity FROM s9 ORDER BY s9.similarity DESC LIMIT 1""",
)
def archetype_match(spark, d):
    return niche.profile_match(grading.graded(spark, d)).select("preset", *r6("similarity"))


# -- timelines --------------------------------------------------------------------

_EV = "SELECT event_id, user_id, floor(epoch(ts)) AS t FROM events"


def _times(spark, d):
    return items.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("exif_ts"))


@query("event_segments", f"WITH e AS ({_EV}), s AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) > 900 THEN 1 ELSE 0 END AS st FROM e) SELECT event_id AS id, CAST(sum(st) OVER (ORDER BY t, event_id) AS BIGINT) AS event FROM s")
def event_segments(spark, d):
    return timeline.events_by_range(_times(spark, d)).select("id", "event")


@query("user_sessions", f"WITH e AS ({_EV}), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 900 THEN 1 ELSE 0 END AS st FROM e), k AS (SELECT user_id, event_id, t, sum(st) OVER (PARTITION BY user_id ORDER BY t, event_id) AS event FROM s) SELECT user_id, CAST(event AS BIGINT) AS event, count(*) AS n, min(t) AS start, max(t) AS stop FROM k GROUP BY user_id, event")
def user_sessions(spark, d):
    s = timeline.segment_events(_times(spark, d), ["user_id"])
    return s.groupBy("user_id", "event").agg(F.count("*").alias("n"), F.min("exif_ts").alias("start"), F.max("exif_ts").alias("stop"))


@query("timeline_sort", f"{G} SELECT path, exif_ts FROM g")
def timeline_sort(spark, d):
    return timeline.in_time_order(grading.graded(spark, d).withColumnRenamed("idx", "id")).select("path", "exif_ts")


def _bursts(spark, d):
    g = grading.graded(spark, d).withColumnRenamed("idx", "id")
    return timeline.consolidate_bursts(timeline.segment_events(g, ["label"]), ["label", "event"], window_s=3000.0, limit=0.9)


_BURSTS = f"""{G.replace("WITH", "WITH RECURSIVE", 1)},
ev0 AS (SELECT *, CASE WHEN exif_ts - lag(exif_ts) OVER (PARTITION BY label ORDER BY exif_ts, idx) > 900 THEN 1 ELSE 0 END AS st FROM g),
ev AS (SELECT *, CAST(sum(st) OVER (PARTITION BY label ORDER BY exif_ts, idx) AS BIGINT) AS event FROM ev0),
o AS (SELECT *, CASE WHEN max(exif_ts) OVER (PARTITION BY label, event) > 0 THEN exif_ts ELSE 0.0 END AS t, row_number() OVER (ORDER BY exif_ts, idx) AS r FROM ev),
nr AS (SELECT a.idx AS a, b.idx AS b, a.r AS r FROM o a JOIN o b ON a.label = b.label AND a.event = b.event AND a.r < b.r WHERE 1 - list_inner_product(a.v, b.v) + abs(a.t - b.t) / CAST(3000 AS DOUBLE) < 0.9),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT w.r + 1, CASE WHEN EXISTS (SELECT 1 FROM nr WHERE nr.b = p.idx AND list_contains(w.kept, nr.a)) THEN w.kept ELSE list_append(w.kept, p.idx) END FROM w JOIN o p ON p.r = w.r + 1),
hd AS (SELECT unnest(kept) AS idx FROM w WHERE r = (SELECT max(r) FROM w)),
mm AS (SELECT idx, idx AS head FROM hd UNION ALL SELECT b, min_by(a, r) FROM nr WHERE a IN (SELECT idx FROM hd) AND b NOT IN (SELECT idx FROM hd) GROUP BY b),
bu AS (SELECT label, event, first(idx ORDER BY score DESC, idx) AS id, max(score) AS score, count(*) AS burst_size FROM o JOIN mm USING (idx) GROUP BY label, event, head)"""


@query("album_bursts", f"{_BURSTS} SELECT label, event, id, burst_size, {s6('score')} FROM bu")
def album_bursts(spark, d):
    return _bursts(spark, d).select("label", "event", "id", "burst_size", *r6("score"))


def _album_sql() -> str:
    out = f"{_BURSTS}, hr AS (SELECT o.* FROM o JOIN bu ON bu.id = o.idx)"
    for k, w in enumerate(selection.ROLES.values()):
        fit = f"(hr.comp * CAST({w[0]} AS DOUBLE) + hr.human * CAST({w[1]} AS DOUBLE) + hr.light * CAST({w[2]} AS DOUBLE))"
        value = f"{fit} * CAST(0.6 AS DOUBLE) + (1.0 - list_inner_product(l.v, hr.v)) * CAST({w[3]} AS DOUBLE) + hr.score * CAST(0.2 AS DOUBLE)" if k else "hr.score"
        last = f" JOIN s{k - 1} l ON l.label = hr.label AND l.event = hr.event" if k else ""
        free = "".join(f" AND hr.idx NOT IN (SELECT idx FROM s{j})" for j in range(k))
        out += f", s{k} AS (SELECT hr.*, {value} AS value FROM hr{last} WHERE true{free} QUALIFY row_number() OVER (PARTITION BY hr.label, hr.event ORDER BY {value} DESC, hr.score DESC, hr.idx) = 1)"
    return out + " " + " UNION ALL ".join(f"SELECT label, event, CAST({k} AS INTEGER) AS pos, '{n}' AS slot, idx, round(value, 6) AS value FROM s{k}" for k, n in enumerate(selection.ROLES))


@query("album_sequences", _album_sql())
def album_sequences(spark, d):
    """The heroes of each event's bursts in their roles."""
    g = cut(grading.graded(spark, d).withColumnRenamed("idx", "id"))
    by = ["label", "event"]
    heroes = timeline.consolidate_bursts(timeline.segment_events(g, ["label"]), by, window_s=3000.0, limit=0.9).select(*by, "id")
    df = cut(g.join(heroes.drop("label"), "id").withColumnRenamed("id", "idx"))
    return selection.assign_roles_by(df, by).select(*by, "pos", "slot", "idx", *r6("value"))


_FLAGSHIP = f"""{G.replace("WITH", "WITH RECURSIVE", 1)},
e AS (SELECT a.idx AS a, b.idx AS b FROM g a JOIN g b ON a.idx < b.idx WHERE list_inner_product(a.v, b.v) > 0.35),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS id, a AS c FROM ee UNION SELECT ee.b, reach.c FROM reach JOIN ee ON ee.a = reach.id),
cl AS (SELECT id, min(c) AS cluster FROM reach GROUP BY id),
w AS (SELECT g.*, coalesce(cluster, -1) AS cluster_id, row_number() OVER o AS r, count(*) OVER (PARTITION BY coalesce(cluster, -1)) AS n FROM g LEFT JOIN cl ON cl.id = g.idx WINDOW o AS (PARTITION BY coalesce(cluster, -1) ORDER BY score DESC, idx)),
p AS (SELECT *, CASE WHEN cluster_id < 0 THEN '' ELSE format('Best of {{}} similar (score {{:.2f}})', n, score) END AS sim_flag FROM w WHERE cluster_id < 0 OR r = 1){sequences.beam_steps()},
top AS (SELECT seq FROM b4 ORDER BY total DESC, seq LIMIT 1)
SELECT CAST(pos - 1 AS INTEGER) AS pos, path, genre, grade, round(score, 6) AS score, sim_flag FROM (SELECT unnest(seq) AS idx, generate_subscripts(seq, 1) AS pos FROM top) JOIN p USING (idx)"""


@query("flagship_sequence", _FLAGSHIP)
def flagship_sequence(spark, d):
    """Grade, then drop all but the best of each duplicate cluster, then the best beam."""
    g = cut(grading.graded(spark, d).withColumnRenamed("idx", "id"))
    labels = similarity.components(spark, similarity.forest(g.select("id", "v"), 0.35))
    best = cut(similarity.best_of_cluster(similarity.duplicate_flags(similarity.with_clusters(g, labels))))
    frames = selection.beam(best.withColumnRenamed("id", "idx")).limit(1).select(F.posexplode("seq").alias("pos", "id"))
    return frames.join(best, "id").select("pos", "path", "genre", "grade", *r6("score"), "sim_flag")
