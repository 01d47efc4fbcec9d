"""Queries over briefs: settings, shifted roles, gates and the whole creative direction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwise.operators import constraints, direction, scoring, selection
from loomwise.plans import grading, items
from loomwise.queries import tables
from loomwise.queries.grading import BRIEF, r6, s6
from loomwise.session import materialised, scratch_path
from loomwise.sources import export

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TEXTS = {"brief": "text", "theme": "coalesce(lang, '') || ' ' || text", "colours": "coalesce(source, '') || ' ' || text"}


def _rules_sql() -> str:
    out: dict[str, list[str]] = {}
    for text, name, value, words in constraints.BRIEF_RULES:
        out.setdefault(name, []).append(f"CASE WHEN {tables._any(text, words)} THEN '{value}' END" if words else f"'{value}'")
    met = " + ".join(f"contains(brief, '{w}')::INT" for w in constraints.GEOMETRY)
    words = "list_filter([" + ", ".join(f"CASE WHEN contains(brief, '{w}') THEN '{w}' END" for w in constraints.KEYWORDS) + "], lambda x: x IS NOT NULL)"
    return ", ".join([f"coalesce({', '.join(c)}) AS {n}" for n, c in out.items()] + [f"{constraints.PRIORITIES!r}[least({met}, 2) + 1] AS geometric_priority", f"{words}[1:4] AS keywords"])


@query("brief_settings", f"SELECT doc_id, {_rules_sql()}, CASE WHEN length(text) > 40 THEN 0.30 WHEN length(text) > 20 THEN 0.25 ELSE 0.20 END::DOUBLE AS slot_threshold FROM (SELECT doc_id, text, {', '.join(f'lower({x}) AS {n}' for n, x in _TEXTS.items())} FROM documents)")
def brief_settings(spark, d):
    docs = items.table(spark, d, "documents").where("text IS NOT NULL")
    found = constraints.brief_settings({n: F.expr(x) for n, x in _TEXTS.items()})
    return docs.select("doc_id", *[c.alias(n) for n, c in found.items()], constraints.slot_threshold(F.col("text")).alias("slot_threshold"))


def _shifted_sql() -> str:
    out = f"WITH w0 AS (SELECT doc_id AS key, {tables._MOOD} AS moods, role, c, h, m, div FROM (SELECT doc_id, lower({tables.PROMPTS}) AS p FROM documents), (VALUES {', '.join(f'({r!r}, {w[0]}::DOUBLE, {w[1]}::DOUBLE, {w[2]}::DOUBLE, {w[3]}::DOUBLE)' for r, w in selection.ROLES.items())}) v(role, c, h, m, div))"
    for k, (mood, dx) in enumerate(constraints.MOOD_SHIFT.items()):
        at = [f"CASE WHEN list_contains(moods, '{mood}') THEN greatest(0.05, {x} + {y})::DOUBLE ELSE {x} END AS {x}" for x, y in zip("chm", dx, strict=True)]
        out += f", x{k} AS (SELECT key, moods, role, {', '.join(at)}, div FROM w{k}), w{k + 1} AS (SELECT key, moods, role, " + ", ".join(f"CASE WHEN list_contains(moods, '{mood}') THEN {x} / (c + h + m) * (1.0 - div) ELSE {x} END AS {x}" for x in "chm") + f", div FROM x{k})"
    return f"{out} SELECT key, role, {', '.join(f'round({x}, 6) AS {n}' for x, n in zip('chm', ('comp', 'human', 'mood'), strict=True))}, div FROM w{len(constraints.MOOD_SHIFT)}"


@query("role_shift", _shifted_sql())
def role_shift(spark, d):
    docs = items.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.expr(tables.PROMPTS).alias("p"))
    moods = docs.select("key", constraints.direction(F.col("p"))["moods"].alias("moods"))
    roles = spark.createDataFrame([(r, *w) for r, w in selection.ROLES.items()], "role string, comp double, human double, mood double, div double")
    return constraints.shifted_roles(moods, roles).select("key", "role", *r6("comp", "human", "mood"), "div")


#: One detected box an item, and the variance of its second differences.
_BOX = "CAST((idx * 13) % 100 AS DOUBLE) / 100 AS conf, CAST((idx * 7) % 50 AS DOUBLE) / 1000 AS w, CAST((idx * 3) % 40 AS DOUBLE) / 1000 AS h, CAST((idx * 11) % 120 AS DOUBLE) AS blum, CASE WHEN idx % 13 > 0 THEN CAST(idx % 90 AS DOUBLE) / 10 END AS variance"


def _gated(spark, d):
    g = grading.graded(spark, d).selectExpr("*", *_BOX.split(", "))
    box = F.array(F.struct("conf", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), "w", "h", F.col("blum").alias("lum")))
    return g.withColumns({"gate": scoring.people_gate(box, F.col("lum"), F.col("lum_std")), "sharp": scoring.sharp_enough(F.col("variance"))})


_GATED = f"{grading.SQL}, bx AS (SELECT *, {_BOX} FROM g), gt AS (SELECT *, CASE WHEN conf >= 0.35 AND w * h >= 0.0008 AND blum >= 15 THEN 'hard' WHEN lum < 35 AND lum_std < 25 THEN 'soft' ELSE 'pass' END AS gate, coalesce(variance, 999.0) >= 4.0 AS sharp FROM bx)"


@query("people_blur_gates", f"{_GATED} SELECT path, gate, sharp FROM gt")
def people_blur_gates(spark, d):
    return _gated(spark, d).select("path", "gate", "sharp")


@query("personal_floor", f"{grading.SQL} SELECT path, {s6('personal')} FROM g WHERE personal >= 0.5")
def personal_floor(spark, d):
    return grading.graded(spark, d).where(scoring.personal_floor(0.5)).select("path", *r6("personal"))


@query("catalog_rows", f"{grading.SQL} SELECT path, grade, {s6('score')} FROM g")
def catalog_rows(spark, d):
    """A catalog, written and read back."""
    from loomwise.session import scratch_path
    from loomwise.sources import files

    at = scratch_path(spark, "catalog")
    files.write_catalog(grading.graded(spark, d).select("path", "grade", *r6("score"), "v"), at)
    return files.read_catalog(spark, at).select("path", "grade", "score")


def _directable(spark, d):
    """Graded rows with the gates as the direction sets them."""
    g = _gated(spark, d)
    box = F.array(F.struct("conf", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), "w", "h", F.col("blum").alias("lum")))
    return g.withColumn("gate", scoring.people_gate(box, F.col("lum"), F.col("lum_std"), min_area=direction.AREA))


@query("creative_direction")
def creative_direction(spark, d):
    """A brief's story, and its files copied in order: the files that stand for pictures hold their notes."""
    base = scratch_path(spark, "direction")
    files = F.concat(F.lit(f"{base}/in/"), "path", F.lit(".jpg"))
    g = materialised(_directable(spark, d).withColumn("path", files), "directable")
    export.write_texts(g, "path", "log").count()
    rules = direction.settings(spark, BRIEF)
    out = direction.finished(direction.directed(g, rules, 0.35, 5), g, rules, f"{base}/Final_Portfolio")
    written = spark.read.format("binaryFile").load(f"{base}/Final_Portfolio").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.decode("content", "UTF-8").alias("note"))
    return out.withColumn("file", F.regexp_extract("target", r"([^/]*)$", 1)).join(written, "file").select("pos", "idx", "role", *r6("score"), "file", "outcome", "note", "log")


#: Whether the brief's rules want no people; its words of emptiness cost rows with people their score in any case.
_HARD = any(w in BRIEF.lower() for _, _, value, words in constraints.BRIEF_RULES if value == "no people" for w in words)
_POOL = f"""{_GATED.replace("WITH", "WITH RECURSIVE", 1).replace("w * h >= 0.0008", "w * h >= 0.0005")},
po AS (SELECT *, row_number() OVER (ORDER BY score DESC, idx) AS r FROM gt WHERE sharp{" AND gate <> 'hard'" if _HARD else ''}),
wk AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT wk.r + 1, CASE WHEN EXISTS (SELECT 1 FROM po k WHERE list_contains(wk.kept, k.idx) AND list_inner_product(k.v, p.v) > 0.35) THEN wk.kept ELSE list_append(wk.kept, p.idx) END FROM wk JOIN po p ON p.r = wk.r + 1),
kp AS (SELECT unnest(kept) AS idx FROM wk WHERE r = (SELECT max(r) FROM wk)),
rs AS (SELECT *, least(greatest(0.60 * CASE WHEN sims[36] > 0.40 OR human > 0.55 THEN score * 0.10 ELSE score END + 0.40 * ({" + ".join(f"{a} * CAST({w} AS DOUBLE)" for a, w in scoring.brief_weights(BRIEF, _HARD).items())}) / CAST({sum(scoring.brief_weights(BRIEF, _HARD).values())} AS DOUBLE), 0.0), 1.0) AS aligned FROM po JOIN kp USING (idx))"""


@query("direction_pool", f"{_POOL} SELECT idx, round(aligned, 6) AS score, CAST(row_number() OVER (ORDER BY aligned DESC, idx) AS INTEGER) AS rank FROM rs ORDER BY aligned DESC, idx LIMIT 40")
def direction_pool(spark, d):
    """The forty rows that a story is picked from, as the creative direction gives them."""
    rows = direction.directed(_directable(spark, d), direction.settings(spark, BRIEF), 0.35, frames=40)
    order = selection.Window.orderBy(F.desc("score"), "idx")  # over forty rows
    return rows.withColumn("rank", F.row_number().over(order)).select("idx", *r6("score"), "rank")
