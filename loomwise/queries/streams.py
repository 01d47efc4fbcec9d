"""Queries that run a stream over a table to its end and read what it wrote, and scans of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loomwise.functions.scalar import file_name
from loomwise.operators.gallery import feedback_pairs
from loomwise.operators.layers import Layers
from loomwise.plans import items
from loomwise.session import scratch_path
from loomwise.sources import export, files
from loomwise.streaming import jobs, queue

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _finished(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _events(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


#: Sessions that the last watermark, an hour behind the newest event, has closed.
_SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS st FROM events),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, st DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 15 MINUTE) AS stop_us, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@query("stream_sessions", _SESSIONS)
def stream_sessions(spark, d):
    out = scratch_path(spark, "sessions")
    _finished(jobs.append_to(jobs.sessions(_events(spark, d), "user_id"), out, scratch_path(spark, "ck")))
    return spark.read.parquet(out).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")


@query("stream_windows", "SELECT event_type, epoch_us(h) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, date_trunc('hour', ts) AS h FROM events) GROUP BY event_type, h HAVING h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_windows(spark, d):
    out = scratch_path(spark, "windows")
    _finished(jobs.append_to(jobs.windowed_counts(_events(spark, d), "event_type"), out, scratch_path(spark, "ck")))
    return spark.read.parquet(out).select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query("watch_upsert", "SELECT 'p' || event_id AS path, event_type AS grade, value AS score FROM events UNION ALL SELECT 'p' || range, 'kept', 0.5 FROM range(10000000, 10000005)")
def watch_upsert(spark, d):
    rows = _events(spark, d).select(F.concat(F.lit("p"), "event_id").alias("path"), F.col("event_type").alias("grade"), F.col("value").alias("score"))
    table = Layers(spark, scratch_path(spark, "watched"), rows.schema, "path")
    old = spark.range(10_000_000, 10_000_005).union(spark.range(3))
    table.upsert(old.select(F.concat(F.lit("p"), "id").alias("path"), F.lit("kept").alias("grade"), F.lit(0.5).alias("score")))
    _finished(jobs.upsert_into(rows, table, scratch_path(spark, "ck")))
    return table.read()


@query("stream_history", "SELECT user_id, list(event_id ORDER BY ts, event_id) AS items FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 25) GROUP BY user_id")
def stream_history(spark, d):
    rows = jobs.histories(_events(spark, d).withColumn("at", F.unix_micros("ts")), "user_id", "event_id", "at")
    table = Layers(spark, scratch_path(spark, "history"), rows.schema, "user_id")
    _finished(jobs.upsert_into(rows, table, scratch_path(spark, "ck")))
    return table.read()


@query(
    "stream_feedback",
    """WITH c AS (SELECT DISTINCT 'p' || (event_id % 500) AS path, [0.28, 0.50, 0.72][event_id % 3 + 1] AS o, [0.28, 0.50, 0.72][user_id % 3 + 1] AS w FROM events)
SELECT path, CAST(greatest(o, w) AS DOUBLE) AS winner, CAST(least(o, w) AS DOUBLE) AS loser, w > o AS upgrade FROM c WHERE o <> w""",
)
def stream_feedback(spark, d):
    e = _events(spark, d)
    rows = e.select(F.concat(F.lit("p"), F.col("event_id") % 500).alias("path"), (F.col("event_id") % 3).cast("int").alias("old_level"), (F.col("user_id") % 3).cast("int").alias("new_level"), "ts")
    out = scratch_path(spark, "pairs")
    _finished(jobs.feedback_into(rows, out, scratch_path(spark, "ck")))
    return spark.read.parquet(out)


@query(
    "feedback_requeue",
    """WITH c AS (SELECT DISTINCT 'p' || (event_id % 500) AS path, [0.28, 0.50, 0.72][event_id % 3 + 1] AS o, [0.28, 0.50, 0.72][user_id % 3 + 1] AS w FROM events)
SELECT path, CAST(greatest(o, w) AS DOUBLE) AS winner, CAST(least(o, w) AS DOUBLE) AS loser, w > o AS upgrade, 'sent' AS state, 3 AS attempts FROM c WHERE o <> w""",
)
def feedback_requeue(spark, d):
    """Pairs whose receiver fails twice: each is received once, at the third attempt."""
    e = _events(spark, d)
    rows = e.select(F.concat(F.lit("p"), F.col("event_id") % 500).alias("path"), (F.col("event_id") % 3).cast("int").alias("old_level"), (F.col("user_id") % 3).cast("int").alias("new_level"))
    pairs = feedback_pairs(rows).withColumn("key", F.concat_ws("/", "path", "winner", "loser", "upgrade"))
    received = Layers(spark, scratch_path(spark, "received"), pairs.schema, "key")
    failures = iter([True, True])

    def send(pending):
        if next(failures, False):
            raise ConnectionError("the receiver is away")
        received.upsert(pending)

    waiting = queue.FeedbackQueue(spark, scratch_path(spark, "queue"), pairs.schema, "key", send)
    _finished(waiting.start(pairs, scratch_path(spark, "ck")))
    waiting.drain()
    return received.read().join(waiting.table.read().select("key", "state", "attempts"), "key").drop("key")


def _document_files(spark, d):
    """Documents as files below a new folder: doc_id, text and path; names repeat from folder to folder."""
    base = scratch_path(spark, "files")
    path = F.concat(F.lit(f"{base}/in/d"), "doc_id", F.lit("/page_"), F.col("doc_id") % 7, F.lit(".txt"))
    docs = items.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), path.alias("path"))
    return base, docs


_EXPORTED = """WITH f AS (SELECT doc_id, text, 'd' || doc_id || '/page_' || (doc_id % 7) || '.txt' AS path, ['Strong', 'Mid', 'Weak'][doc_id % 3 + 1] AS grade, 'page_' || (doc_id % 7) AS stem FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY grade, stem ORDER BY path) - 1 AS r FROM f WHERE grade <> 'Weak' AND doc_id % 11 <> 0)"""


@query(
    "export_files",
    f"""{_EXPORTED} SELECT f.path AS source, CASE WHEN n.r IS NOT NULL THEN f.grade || '/' || f.stem || CASE WHEN n.r = 0 THEN '' ELSE '_' || n.r END || '.txt' END AS target,
CASE WHEN n.r IS NOT NULL THEN 'copied' WHEN f.grade = 'Weak' THEN 'skipped' ELSE 'error' END AS outcome, CASE WHEN n.r IS NOT NULL THEN sha256(coalesce(f.text, '')) END AS sha256
FROM f LEFT JOIN n USING (doc_id)""",
)
def export_files(spark, d):
    """Files copied by grade, twice over as a task that runs again would, then listed and compared; a file in eleven is missing."""
    base, docs = _document_files(spark, d)
    export.write_texts(docs.where("doc_id % 11 <> 0"), "path", "text").count()
    grade = F.get(F.array(*map(F.lit, ("Strong", "Mid", "Weak"))), (F.col("doc_id") % 3).cast("int")).alias("grade")
    report = export.export_files(docs.select("path", grade), f"{base}/out", ["Strong", "Mid"])
    inner = lambda c, part: F.regexp_replace(c, f"^.*/{part}/", "")
    there = export.digests(export.listed(spark, [f"{base}/out"])).select(inner("path", "out").alias("target"), "sha256")
    told = report.select(inner("source", "in").alias("source"), inner("target", "out").alias("target"), "outcome")
    return told.join(there, "target", "full_outer").select("source", "target", "outcome", "sha256")


@query("content_fingerprint", "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents")
def content_fingerprint(spark, d):
    """Documents as files, and of each the first file that holds the same; rows that repeat an id with other text have files of their own."""
    base = f"{scratch_path(spark, 'files')}/in"
    text = F.coalesce("text", F.lit(""))
    path = F.concat(F.lit(f"{base}/d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("_"), F.xxhash64(text), F.lit("/page.txt"))
    docs = items.table(spark, d, "documents").select("doc_id", text.alias("text"), path.alias("path"))
    told = export.write_texts(docs, "path", "text")
    lost = export.counts(told).first()["errors"]
    if lost:
        raise OSError(f"{lost} documents were not written")
    found = export.fingerprints(export.listed(spark, [base]), chunk=1000)
    # a row for each document, and not for each file, which rows that repeat as a whole share
    of = told.select(F.col("target").alias("path"), F.regexp_extract("target", r"/d(-?\d*)_[^/]*/[^/]*$", 1).alias("d")).join(found, "path")
    of = of.select(F.when(F.col("d") != "", F.col("d").cast("long")).alias("doc_id"), "size", "fingerprint")
    first = of.groupBy("fingerprint", F.col("size").alias("s")).agg(F.min("doc_id").alias("first"))
    return of.join(first, "fingerprint").select("doc_id", "first")


@query(
    "sidecar_files",
    """SELECT doc_id, CAST(least(greatest(round_even(doc_id % 90 / 90.0 * 5, 0), 0), 5) AS INTEGER) AS rating, coalesce(lang, '') AS label, sha256(coalesce(text, '')) AS sha256 FROM documents""",
)
def sidecar_files(spark, d):
    """XMP sidecars of all documents, read back field by field."""
    base = scratch_path(spark, "sidecars")
    docs = items.table(spark, d, "documents").select(F.concat(F.lit("in/doc"), "doc_id", F.lit(".txt")).alias("path"), (F.col("doc_id") % 90 / 90).alias("score"), F.col("lang").alias("grade"), F.col("text").alias("critique"), F.lit("{}").alias("breakdown"))
    export.write_sidecars(docs, base).count()
    text = export.contents(export.listed(spark, [base])).select("path", F.decode("content", "UTF-8").alias("x"))
    field = lambda tag: F.regexp_extract("x", f"(?s)<{tag}>(.*)</{tag}>", 1)
    plain = field("dc:description")
    for sign, name in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return text.select(F.regexp_extract("path", r"doc(\d+)\.xmp$", 1).cast("long").alias("doc_id"), field("xmp:Rating").cast("int").alias("rating"), field("xmp:Label").alias("label"), F.sha2(plain, 256).alias("sha256"))


_FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("folder_scan", "SELECT * FROM (VALUES " + ", ".join(f"('{n}.parquet')" for n in _FILES) + ") t(name)")
def folder_scan(spark, d):
    found = files.scan(spark, [d, d], ["parquet"], bundles=True)
    return files.listing(found).select("name")


@query("scan_fingerprint")
def scan_fingerprint(spark, d):
    return files.fingerprint(files.scan(spark, [d], ["parquet"], recursive=True)).select(file_name(F.col("path")).alias("name"), "fingerprint")


@query(
    "sqlite_import",
    """SELECT 'p' || vec_id AS path, CASE WHEN vec_id % 6 > 1 THEN vec_id % 6 / 6.0 ELSE 0.5 END::DOUBLE AS score, CASE WHEN vec_id % 4 > 1 THEN 'Strong' ELSE 'Mid' END AS grade,
CASE WHEN vec_id % 5 > 0 THEN vec_id ELSE 0 END::DOUBLE AS exif_ts, len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
)
def sqlite_import(spark, d):
    """Embeddings as SQLite files, a file a task, read back with the defaults for nulls, zeros and empty texts."""
    e = items.table(spark, d, "embeddings").selectExpr(
        "concat('p', vec_id) AS path", "embedding", "CASE WHEN vec_id % 6 > 1 THEN vec_id % 6 / 6D WHEN vec_id % 6 = 1 THEN 0D END AS score",
        "CASE WHEN vec_id % 4 > 1 THEN 'Strong' WHEN vec_id % 4 = 1 THEN '' END AS grade", "CASE WHEN vec_id % 5 > 0 THEN CAST(vec_id AS DOUBLE) END AS exif_ts",
    )
    at = scratch_path(spark, "sqlite").removeprefix("file://").removeprefix("file:")
    found = files.sqlite_folder(spark, files.write_sqlite(e.repartition(3), at, "embeddings"), "embeddings")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda x, y: x + y)
    return found.select("path", "score", "grade", "exif_ts", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


@query(
    "saved_documents",
    """SELECT 'sequence' AS kind, 'c' || conv_id AS name, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INTEGER) AS pos, 't' || turn || '/' || role AS path, CAST(NULL AS DOUBLE) AS weight FROM conversations
UNION ALL SELECT 'used', NULL, NULL, 'p' || doc_id, NULL FROM labels WHERE toxic = 1
UNION ALL SELECT 'locked', NULL, NULL, 'p' || doc_id, NULL FROM labels WHERE quality = 1
UNION ALL SELECT 'preset', 'u' || user_id, NULL, event_type, round(sum(value), 4) FROM events GROUP BY user_id, event_type""",
)
def saved_documents(spark, d):
    """Sequences, used and locked paths and presets, written as JSON documents of a hundred entries and read back."""
    base = scratch_path(spark, "documents")
    hundred = lambda c: F.floor(F.col(c) / 100)
    turns = items.table(spark, d, "conversations")
    frames = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: F.concat(F.lit("t"), t.turn, F.lit("/"), t.role))
    one = turns.groupBy("conv_id").agg(F.struct(F.concat(F.lit("c"), "conv_id").alias("name"), frames.alias("paths")).alias("s"))
    sequences = one.groupBy(hundred("conv_id").alias("k")).agg(F.to_json(F.struct(F.collect_list("s").alias("sequences"))).alias("doc"))
    labels = items.table(spark, d, "labels").withColumn("path", F.concat(F.lit("p"), "doc_id")).groupBy(hundred("doc_id").alias("k"))
    chosen = lambda c: F.collect_list(F.when(F.col(c) == 1, F.col("path")))
    used = labels.agg(F.to_json(chosen("toxic")).alias("doc"))
    flags = labels.agg(F.to_json(F.struct(chosen("quality").alias("locked"), F.array().cast("array<string>").alias("used"))).alias("doc"))
    sums = items.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("w"))
    weights = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "w"))).alias("m"))
    presets = weights.groupBy(hundred("user_id").alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("u"), "user_id"), "m")))).alias("doc"))
    for kind, docs in (("sequences", sequences), ("used", used), ("flags", flags), ("presets", presets)):
        export.write_texts(docs.withColumn("path", F.concat(F.lit(f"{base}/{kind}/"), "k", F.lit(".json"))), "path", "doc").count()
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        files.saved_sequences(spark, f"{base}/sequences").select(F.lit("sequence").alias("kind"), "name", "pos", "path", none("double").alias("weight")),
        files.used_paths(spark, f"{base}/used").select(F.lit("used").alias("kind"), none("string").alias("name"), none("int").alias("pos"), "path", none("double").alias("weight")),
        files.flags(spark, f"{base}/flags").select(F.col("flag").alias("kind"), none("string").alias("name"), none("int").alias("pos"), "path", none("double").alias("weight")),
        files.presets(spark, f"{base}/presets").select(F.lit("preset").alias("kind"), "name", none("int").alias("pos"), F.col("key").alias("path"), F.col("weight")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("positional_zip", "SELECT vec_id AS pos, 'p' || doc_id AS path FROM embeddings LEFT JOIN labels ON doc_id = vec_id")
def positional_zip(spark, d):
    # the metadata as parallel arrays for a hundred positions each
    first = (F.floor(F.col("doc_id") / 100) * 100).cast("long").alias("first")
    known = items.table(spark, d, "labels").groupBy(first).agg(F.collect_set("doc_id").alias("ids"))
    at = F.sequence(F.col("first"), F.col("first") + 99)
    meta = known.select("first", F.transform(at, lambda k: F.when(F.array_contains("ids", k), F.concat(F.lit("p"), k))).alias("path"))
    v = items.table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"))
    return files.zipped(v, meta, ["path"]).select("pos", "path")


@query("tiered_source", "SELECT 'p' || vec_id AS path, CAST(0.75 AS DOUBLE) AS score FROM embeddings ORDER BY path LIMIT 50")
def tiered_source(spark, d):
    found = items.table(spark, d, "embeddings").select(F.concat(F.lit("p"), "vec_id").alias("path"))
    none = files.fallback_rows(found.where("false"), 0.9)
    return files.first_with_rows([none, files.fallback_rows(found, 0.75, 50), files.fallback_rows(found, 0.5)])
