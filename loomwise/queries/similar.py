"""Queries over vectors: joins, clusters, search and prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwise.functions.vectors import cosine, doubles, fit, norm
from loomwise.operators import niche, quantised, similarity
from loomwise.plans import grading, items
from loomwise.queries.grading import r6, s6
from loomwise.session import materialised

QUERIES, SQL = {}, {}
#: The test vectors are far apart: no pair reaches the usual 0.96.
NEAR = 0.35
SEED = niche.seed_sql


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


U = f"WITH RECURSIVE {items.SQL}"
EDGES = f"e AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.v, b.v) AS cos FROM u a JOIN u b ON a.id < b.id WHERE list_inner_product(a.v, b.v) > {NEAR})"
CLUSTERS = f"""{EDGES},
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS id, a AS c FROM ee UNION SELECT ee.b, reach.c FROM reach JOIN ee ON ee.a = reach.id),
cl AS (SELECT id, min(c) AS cluster FROM reach GROUP BY id),
sc AS (SELECT u.id, 'item_' || u.id AS path, coalesce(cluster, -1) AS cluster_id, CAST((u.id * 7919) % 100 AS DOUBLE) / 100 AS score, v FROM u LEFT JOIN cl USING (id))"""


def scored(spark, d):
    u = items.units(spark, d)
    return u.select("id", F.concat(F.lit("item_"), "id").alias("path"), (((F.col("id") * 7919) % 100).cast("double") / 100).alias("score"), "v")


def clustered(spark, d):
    df = scored(spark, d)
    return similarity.with_clusters(df, similarity.components(spark, similarity.forest(df, NEAR)))


@query("sim_edges", f"{U}, {EDGES} SELECT a, b, round(cos, 6) AS cos FROM e")
def sim_edges(spark, d):
    return similarity.edges(items.units(spark, d), NEAR).select("a", "b", *r6("cos"))


@query("sim_edges_theta", f"{U}, {EDGES} SELECT a, b, round(cos, 6) AS cos FROM e")
def sim_edges_theta(spark, d):
    return similarity.edges_sql(items.units(spark, d), NEAR).select("a", "b", *r6("cos"))


@query("knn_topk", f"{U}, k AS (SELECT u.id, list_inner_product(u.v, q.v) AS cos FROM u, (SELECT v FROM u WHERE id = 0) q) SELECT id, round(cos, 6) AS cos, round(1 - cos, 6) AS distance FROM k ORDER BY cos DESC, id LIMIT 20")
def knn_topk(spark, d):
    u = items.units(spark, d)
    q = u.where("id = 0").select(F.col("v").alias("q"))  # one row
    return similarity.nearest(u.crossJoin(F.broadcast(q)), F.col("q"), 20).select("id", *r6("cos", "distance"))


@query("knn_prefilter", f"{U}, k AS (SELECT u.id, list_inner_product(u.v, q.v) AS cos FROM u, (SELECT v FROM u WHERE id = 1) q WHERE u.label >= 5) SELECT id, round(cos, 6) AS cos FROM k ORDER BY cos DESC, id LIMIT 10")
def knn_prefilter(spark, d):
    u = items.units(spark, d)
    q = u.where("id = 1").select(F.col("v").alias("q"))
    return similarity.nearest(u.crossJoin(F.broadcast(q)), F.col("q"), 10, F.col("label") >= 5).select("id", *r6("cos"))


@query("text_ranking", f"{U}, k AS (SELECT u.id, CASE WHEN u.id % 9 = 0 THEN 0.0 ELSE list_inner_product(u.v, q.v) END AS sim FROM u, (SELECT v FROM u WHERE id = 2) q) SELECT id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM k QUALIFY rank <= 50")
def text_ranking(spark, d):
    u = items.units(spark, d)
    q = u.where("id = 2").select(F.col("v").alias("q"))
    sim = F.when(F.col("id") % 9 == 0, 0.0).otherwise(similarity.dot(F.col("v"), F.col("q")))
    top = u.crossJoin(F.broadcast(q)).select("id", sim.alias("sim")).orderBy(F.desc("sim"), "id").limit(50)
    order = similarity.Window.orderBy(F.desc("sim"), "id")  # over the 50 rows
    return top.withColumn("rank", F.row_number().over(order)).select("id", *r6("sim"), F.col("rank").cast("long").alias("rank"))


@query("topk_mean_sim", f"{U}, k AS (SELECT u.id, row_number() OVER (PARTITION BY u.id ORDER BY list_inner_product(u.v, q.v) DESC) AS r, list_inner_product(u.v, q.v) AS s FROM u, (SELECT v FROM u WHERE id < 36) q) SELECT id, round(avg(s), 6) AS mean_sim FROM k WHERE r <= 5 GROUP BY id")
def topk_mean_sim(spark, d):
    u = items.units(spark, d)
    return similarity.topk_mean(u, u.where("id < 36")).select("id", *r6("mean_sim"))


@query(
    "hybrid_dup",
    f"""{U}, h AS (SELECT id, v, (id * 2654435761) % 4294967296 AS h FROM u), p AS (SELECT a.id AS a, b.id AS b, 0.4 * (1 - bit_count(xor(a.h, b.h)) / CAST(64 AS DOUBLE)) + 0.6 * list_inner_product(a.v, b.v) AS s FROM h a JOIN h b ON b.id = a.id + 1)
SELECT a, b, round(s, 6) AS score, s > 0.45 AS likely FROM p""",
)
def hybrid_dup(spark, d):
    h = items.units(spark, d).select("id", "v", ((F.col("id") * 2654435761) % 4294967296).alias("h"))
    n = h.select((F.col("id") - 1).alias("j"), F.col("id").alias("b"), F.col("v").alias("vb"), F.col("h").alias("hb"))
    s = similarity.duplicate_score(F.col("h"), F.col("hb"), similarity.dot(F.col("v"), F.col("vb")))
    return h.join(n, h.id == n.j).select(F.col("id").alias("a"), "b", s.alias("s")).select("a", "b", F.round("s", 6).alias("score"), (F.col("s") > 0.45).alias("likely"))


@query(
    "pad_truncate",
    "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(CAST(embedding AS DOUBLE[])[1:48], lambda x: x * x)), 5) AS cut, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 5) AS padded FROM embeddings",
)
def pad_truncate(spark, d):
    e = items.table(spark, d, "embeddings").select("vec_id", doubles("embedding").alias("e"))
    square = lambda v: F.round(F.pow(norm(v), 2), 5)
    return e.select("vec_id", F.size("e").cast("long").alias("n"), square(fit(F.col("e"), 48)).alias("cut"), square(fit(F.col("e"), 100)).alias("padded"))


@query("pair_cosine", f"{U} SELECT a.id, round(list_inner_product(a.v, b.v), 5) AS cos, round((list_inner_product(a.v, b.v) + 1) / 2, 5) AS sim01 FROM u a JOIN u b ON b.id = a.id + 1")
def pair_cosine(spark, d):
    e = items.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), doubles("embedding").alias("e"))
    n = e.select((F.col("id") - 1).alias("j"), F.col("e").alias("f"))
    return e.join(n, e.id == n.j).select("id", F.round(cosine(F.col("e"), F.col("f")), 5).alias("cos"), F.round((cosine(F.col("e"), F.col("f")) + 1) / 2, 5).alias("sim01"))


@query("dup_clusters", f"{U}, {CLUSTERS} SELECT id, cluster_id FROM sc")
def dup_clusters(spark, d):
    return clustered(spark, d).select("id", "cluster_id")


@query(
    "dup_flags",
    f"""{U}, {CLUSTERS}, w AS (SELECT *, row_number() OVER p AS r, count(*) OVER (PARTITION BY cluster_id) AS n, first_value(path) OVER p AS bp, first_value(score) OVER p AS bs FROM sc WINDOW p AS (PARTITION BY cluster_id ORDER BY score DESC, id))
SELECT id, CASE WHEN cluster_id < 0 THEN '' WHEN r = 1 THEN format('Best of {{}} similar (score {{:.2f}})', n, score) ELSE format('Duplicate: {{}} is better (+{{:.2f}})', bp, bs - score) END AS sim_flag FROM w""",
)
def dup_flags(spark, d):
    return similarity.duplicate_flags(clustered(spark, d)).select("id", "sim_flag")


@query("best_of_cluster", f"{U}, {CLUSTERS} SELECT id, cluster_id, score FROM sc WHERE cluster_id < 0 OR id = (SELECT s.id FROM sc s WHERE s.cluster_id = sc.cluster_id ORDER BY s.score DESC, s.id LIMIT 1)")
def best_of_cluster(spark, d):
    return similarity.best_of_cluster(clustered(spark, d)).select("id", "cluster_id", "score")


@query("dup_groups", f"{U}, {CLUSTERS} SELECT cluster_id, count(*) AS n, first(path ORDER BY score DESC, id) AS best, list(path ORDER BY score DESC, id) AS members FROM sc WHERE cluster_id >= 0 GROUP BY cluster_id")
def dup_groups(spark, d):
    return similarity.duplicate_groups(clustered(spark, d))


_POOL = "pool AS (SELECT id, v, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM sc)"


@query(
    "greedy_dedup",
    f"""{U}, {CLUSTERS}, {_POOL},
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT w.r + 1, CASE WHEN EXISTS (SELECT 1 FROM pool k WHERE list_contains(w.kept, k.id) AND list_inner_product(k.v, p.v) > {NEAR - 0.1:.2f}) THEN w.kept ELSE list_append(w.kept, p.id) END FROM w JOIN pool p ON p.r = w.r + 1)
SELECT unnest(kept) AS id FROM w WHERE r = (SELECT max(r) FROM w)""",
)
def greedy_dedup(spark, d):
    return similarity.greedy_dedup(spark, scored(spark, d), round(NEAR - 0.1, 2)).select("id")


@query(
    "bank_add",
    f"""{U}, n AS (SELECT id, v, row_number() OVER (ORDER BY id) AS r FROM u WHERE id >= 36 AND NOT EXISTS (SELECT 1 FROM u b WHERE b.id < 36 AND list_inner_product(b.v, u.v) > 0.30)),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT w.r + 1, CASE WHEN EXISTS (SELECT 1 FROM n k WHERE list_contains(w.kept, k.id) AND list_inner_product(k.v, p.v) > 0.30) THEN w.kept ELSE list_append(w.kept, p.id) END FROM w JOIN n p ON p.r = w.r + 1)
SELECT unnest(kept) AS id FROM w WHERE r = (SELECT max(r) FROM w)""",
)
def bank_add(spark, d):
    u = items.units(spark, d)
    return similarity.add_to_bank(spark, u.where("id >= 36"), u.where("id < 36"), 0.30).select("id")


_CENTRE = "c0 AS (SELECT label, k, sum(v[k]) AS s FROM u, range(1, 65) t(k) GROUP BY ALL), c1 AS (SELECT label, list(s ORDER BY k) AS s FROM c0 GROUP BY label), c2 AS (SELECT label, s, sqrt(list_inner_product(s, s)) AS n FROM c1)"


@query("centroid", f"{U}, {_CENTRE} SELECT label, round(s[1] / (n + 1e-9), 6) AS first, round(s[64] / (n + 1e-9), 6) AS last FROM c2")
def centroid(spark, d):
    c = similarity.centroid(items.units(spark, d), "label")
    return c.select("label", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 64), 6).alias("last"))


_PROTO = f"""{grading.SQL}, sd0 AS (SELECT idx AS id, v, comp AS c, tech AS t, human AS h, light AS l, narr AS a FROM g), sd1 AS (SELECT id, v, {SEED("list")} AS s FROM sd0),
sd AS (SELECT id, v, list_max(list_transform(s, lambda x: x.s)) AS seed, list_filter(s, lambda x: x.s = list_max(list_transform(s, lambda y: y.s)))[1].n AS niche FROM sd1),
rk AS (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY seed DESC, id) AS r, count(*) OVER (PARTITION BY niche) AS n FROM sd WHERE seed > 0.40),
tp AS (SELECT * FROM rk WHERE n >= 3 AND r <= greatest(3, n // 3)),
p0 AS (SELECT niche, k, sum(v[k] * seed) AS s FROM tp, range(1, 65) t(k) GROUP BY ALL), p1 AS (SELECT niche, list(s ORDER BY k) AS s FROM p0 GROUP BY niche),
pt AS (SELECT niche, list_transform(s, lambda x: x / (sqrt(list_inner_product(s, s)) + 1e-9)) AS v FROM p1)"""


def _seeded(spark, d):
    g = grading.graded(spark, d).select(F.col("idx").alias("id"), "v", "comp", "tech", "human", "light", F.col("narr").alias("auth"))
    # the rows with their lineage cut, as each seed holds the expressions of all calibrated aspects
    return niche.seed_niche(materialised(g, "graded"))


@query("niche_seed", f"{_PROTO} SELECT id, niche, round(seed, 6) AS seed FROM sd")
def niche_seed(spark, d):
    return _seeded(spark, d).select("id", "niche", *r6("seed"))


@query(
    "prototype_classify",
    f"""{_PROTO}, z AS (SELECT g.idx AS id, niche, list_inner_product(g.v, pt.v) * 8.0 AS z FROM g, pt), e AS (SELECT id, niche, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z)
SELECT id, niche, round(e / (sum(e) OVER (PARTITION BY id) + 1e-9), 6) AS prob FROM e""",
)
def prototype_classify(spark, d):
    s = materialised(_seeded(spark, d), "seeded")
    return similarity.classify(s, similarity.prototypes(s)).select("id", "niche", *r6("prob"))


@query("pair_diversity", f"{U}, p AS (SELECT list_inner_product(a.v, b.v) AS c FROM u a JOIN u b ON a.id < b.id) SELECT round(greatest(0.0, 1 - avg(c)), 6) AS mean_diversity, round(1 - max(c), 6) AS worst_diversity FROM p")
def pair_diversity(spark, d):
    return similarity.diversity(items.units(spark, d)).select(*r6("mean_diversity", "worst_diversity"))


@query("adjacent_pairs", f"{U}, p AS (SELECT label, idx AS a, lead(idx) OVER (PARTITION BY label ORDER BY exif_ts, idx) AS b FROM it) SELECT * FROM p WHERE b IS NOT NULL")
def adjacent_pairs(spark, d):
    return similarity.adjacent_pairs(items.items(spark, d).withColumnRenamed("idx", "id"))


@query("lsh_edges")
def lsh_edges(spark, d):
    return similarity.lsh_edges(items.units(spark, d), NEAR).select("a", "b", *r6("cos"))


@query("cell_search")
def cell_search(spark, d):
    """The twenty nearest rows of each row whose id is divisible by 20, by the index; tests measure its recall."""
    u = items.units(spark, d)
    return similarity.CellIndex(u).search(u.where("id % 20 = 0"), probes=12).select("query_id", "rank", "id", *r6("cos"))


@query(
    "quantised_search",
    f"""{U}, k AS (SELECT q.id AS query_id, u.id, list_inner_product(u.v, q.v) AS cos FROM u JOIN u q ON q.id % 20 = 0 AND u.id <> q.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS INTEGER) AS rank, id, round(cos, 6) AS cos FROM k QUALIFY rank <= 20""",
)
def quantised_search(spark, d):
    """The twenty nearest rows of each row whose id is divisible by 20, exactly, by bounds from the bytes of all cells."""
    u = items.units(spark, d)
    return quantised.ProductIndex(u).search(u.where("id % 20 = 0"), probes=16, rerank=None).select("query_id", "rank", "id", *r6("cos"))


@query("kmeans_labels")
def kmeans_labels(spark, d):
    g = grading.graded(spark, d).where("score > 0.20").select(F.col("idx").alias("id"), "v")
    return similarity.kmeans_labels(g)


@query("preference_rank")
def preference_rank(spark, d):
    """Learns from neighbours in time of one label that were judged apart."""
    it = items.items(spark, d).select(F.col("idx").alias("id"), "v", "label", "personal")
    near = similarity.adjacent_pairs(items.items(spark, d).withColumnRenamed("idx", "id"))
    judged = lambda s: it.select(F.col("id").alias(s), F.col("personal").alias(f"p{s}"))
    both = near.join(judged("a"), "a").join(judged("b"), "b").where("pa <> pb")
    pairs = both.select(F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(F.col("pa") > F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("loser"))
    return similarity.preference_rank(pairs, it)


@query("ensemble_mean", f"{U}, c0 AS (SELECT k, sum(v[k]) AS s FROM u, range(1, 65) t(k) WHERE id < 5 GROUP BY k), c1 AS (SELECT list(s ORDER BY k) AS s FROM c0) SELECT {s6('m')} FROM (SELECT unnest(list_transform(s, lambda x: x / (sqrt(list_inner_product(s, s)) + 1e-9))) AS m FROM c1)")
def ensemble_mean(spark, d):
    return similarity.centroid(items.units(spark, d).where("id < 5")).select(F.explode("v").alias("m")).select(*r6("m"))
