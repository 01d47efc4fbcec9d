"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased;
128 bits of its MD5 stand for it. Documents come in batches. A batch becomes a run:
for each hash its ``min_docs`` largest documents. It is merge-anti-joined with the
runs so far, which drops the hashes that a run has settled, as it has enough
documents of its own and none of them is smaller; what is left is added as a run
at level 0. When a level holds ``fanout`` runs they are merged into one run of the
next level, so that the number of runs grows with the logarithm of the batches. A
hash with ``min_docs`` documents loses its lines except in the largest.

Runs are tables bucketed and sorted by hash, so that the anti-joins read them in
place, without a shuffle. They stay in their folder, which can be opened again to
add later batches. As a run keeps documents and not counts, batches may come in
any order, and one that comes twice changes nothing.

Only hashes are shuffled, cut to the largest documents in each task; a very common
line is a few rows of each task. The text is joined once with the positions
that it loses.

Defined results. A null or empty text is one empty line. Lines shorter than
``min_chars`` code points after stripping always stay. A null doc_id sorts
lowest. Rows that repeat a doc_id are one document with several texts: all of them
keep the lines that this document keeps. Empty tables give empty results; other
columns pass through, but for those with the names of the new ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwise.llm.common import ascii_lower, broadcast_if_small, forget, others, row_key, written
from loomwise.session import remove_path, scratch_path

SPACE = " \t\n\x0b\x0c\r"
LOWEST = -(2**63)
#: Dropped positions, and documents that lose any, up to which these are broadcast.
POSITIONS, DOCS = 2_000_000, 200_000


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LOWEST))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, rk, pos and h of every line that is long enough to be dropped."""
    lines = docs.select(_id(F.col("doc_id")).alias("doc"), row_key(F.col("text")).alias("rk"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "rk", "pos", ascii_lower(F.trim("line", F.lit(SPACE))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("doc", "rk", "pos", F.unhex(F.md5("key")).alias("h"))


class LineRuns:
    """Sorted runs (h, docs) by level below a folder; docs are the largest ``keep`` documents of a hash, largest first.

    A folder that holds runs is opened with them, and with its keep and number of buckets.
    """

    schema = "h binary, docs array<bigint>"

    def __init__(self, spark: SparkSession, keep: int = 3, fanout: int = 3, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch_path(spark, "runs")
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.files = self.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = {"keep": keep, "fanout": fanout, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [[]], "version": 0}
        if states := self._states():
            self.state = json.loads(spark.read.text(f"{self.folder}/{states[-1]}", wholetext=True).first()[0])
        self.names: dict[str, str] = {}

    def _states(self) -> list[str]:
        root = self.fs.Path(self.folder)
        names = [s.getPath().getName() for s in self.files.listStatus(root)] if self.files.exists(root) else []
        return sorted(n for n in names if n.startswith("state-"))

    def _commit(self) -> None:
        """Write the levels as a new state; a lost driver leaves the one before in force."""
        self.state["version"] += 1
        name = f"state-{self.state['version']:08d}"
        temp = self.fs.Path(f"{self.folder}/.{name}.{uuid.uuid4().hex}")
        out = self.files.create(temp, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if not self.files.rename(temp, self.fs.Path(f"{self.folder}/{name}")):
            raise OSError(f"could not write {name}")

    def _store(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        run.write.format("parquet").bucketBy(self.state["buckets"], "h").sortBy("h").option("path", path).saveAsTable(name)
        self.names[path] = name
        return path

    def _read(self, path: str) -> DataFrame:
        """A run as a bucketed table, which this session may not know yet."""
        if path not in self.names:
            self.names[path] = f"line_run_{uuid.uuid4().hex}"
            at = path.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {self.names[path]} (h BINARY, docs ARRAY<BIGINT>) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.state['buckets']} BUCKETS LOCATION '{at}'")
        return self.spark.table(self.names[path])

    def _forget(self, path: str) -> None:
        if path in self.names:
            self.spark.sql(f"DROP TABLE {self.names.pop(path)}")
        remove_path(self.spark, path)

    def _merged(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        # as plain files: Spark 4.1 takes a union of bucketed tables for bucketed even where it reads them otherwise
        all_ = self.spark.read.schema(self.schema).parquet(*paths)
        return all_.groupBy("h").agg(F.flatten(F.collect_list("docs")).alias("docs")).select("h", self._largest(F.col("docs")).alias("docs"))

    def _largest(self, docs: Column) -> Column:
        return F.slice(F.sort_array(F.array_distinct(docs), asc=False), 1, self.state["keep"])

    def paths(self) -> list[str]:
        return [p for level in self.state["levels"] for p in level]

    def clear(self) -> None:
        for p in self.paths():
            self._forget(p)
        remove_path(self.spark, self.folder)
        self.state["levels"] = [[]]

    def unsettled(self, run: DataFrame) -> DataFrame:
        """Rows of a run whose hash no run so far has settled: with keep documents, the smallest no smaller than the row's largest."""
        keep = self.state["keep"]
        for p in self.paths():
            known = self._read(p).where(F.size("docs") == keep).select(F.col("h").alias("k"), F.get("docs", F.lit(keep - 1)).alias("least"))
            run = run.join(known, (run.h == known.k) & (known.least >= F.get(run.docs, F.lit(0))), "left_anti")
        return run

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (doc, h)."""
        order = Window.partitionBy("h").orderBy(F.desc("doc"))
        few = lines.select("h", "doc").withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= self.state["keep"])
        run = few.groupBy("h").agg(F.collect_set("doc").alias("docs")).select("h", self._largest(F.col("docs")).alias("docs"))
        levels = self.state["levels"]
        levels[0].append(self._store(self.unsettled(run)))
        gone, k = [], 0
        while len(levels[k]) >= self.state["fanout"]:
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(self._store(self._merged(levels[k])))
            gone += levels[k]
            levels[k] = []
            k += 1
        self._commit()
        for p in gone:
            self._forget(p)

    def frequent(self) -> DataFrame:
        """h and owner, the largest document, of the hashes with keep documents."""
        return self._merged(self.paths()).where(F.size("docs") == self.state["keep"]).select("h", F.get("docs", F.lit(0)).alias("owner"))


def batches_of(docs: DataFrame, n: int) -> list[Column]:
    """Conditions that cut documents into about n parts by doc_id, the largest ids first; nulls come last."""
    shares = [k / n for k in range(1, n)]
    got = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000)).first()[0] if shares else None  # n - 1 numbers
    cuts = sorted(set(got or []), reverse=True)
    doc = F.col("doc_id").cast("long")
    out, above = [], F.lit(True)
    for c in cuts:
        out.append(above & (doc > c))
        above = doc <= c
    return [*out, doc.isNull() | above] if cuts else [F.lit(True)]


def dropped_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, folder: str | None = None) -> DataFrame:
    """doc, rk and the sorted positions of the lines that each document loses; documents that lose none are absent.

    With ``folder`` the documents are added to the runs kept there, and lines are
    also frequent by the documents of earlier calls; else runs last for this call.
    """
    runs, parts = LineRuns(spark, min_docs, fanout, folder), []
    for k, cond in enumerate(batches_of(docs, batches)):
        parts.append(written(spark, lines_of(docs.where(cond), min_chars), f"lines{k}"))
        runs.add(parts[-1])
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    frequent = written(spark, runs.frequent(), "frequent")
    lost = lines.join(broadcast_if_small(frequent), "h").where(F.col("doc") != F.col("owner"))
    drops = written(spark, lost.groupBy("doc", "rk").agg(F.array_sort(F.collect_set("pos")).alias("drops")), "drops")
    forget(frequent, *parts)
    if folder is None:
        runs.clear()
    return drops


NAMES = ("kept_text", "n_lines", "n_dropped")


def dedup_lines(spark: SparkSession, docs: DataFrame, names: tuple[str, str, str] = NAMES, **kw) -> DataFrame:
    """The documents with the kept text, and the numbers of lines and of dropped lines, added under ``names``."""
    drops = dropped_lines(spark, docs, **kw)
    n, positions = drops.agg(F.count("*"), F.sum(F.size("drops"))).first()
    if n <= DOCS and (positions or 0) <= POSITIONS:
        drops = F.broadcast(drops)
    same = (_id(docs.doc_id) == drops.doc) & (row_key(docs.text) == drops.rk)
    lines = F.split(F.coalesce(docs.text, F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops.drops)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    n_lines = (F.length(F.coalesce(docs.text, F.lit(""))) - F.length(F.replace(F.coalesce(docs.text, F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return docs.join(drops, same, "left").select(
        *[docs[c] for c in others(docs.columns, *names)],
        F.when(drops.drops.isNull(), F.coalesce(docs.text, F.lit(""))).otherwise(kept).alias(names[0]),
        n_lines.alias(names[1]),
        F.coalesce(F.size(drops.drops), F.lit(0)).cast("long").alias(names[2]),
    )


def op4_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
f AS (SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, f.owner IS NOT NULL AND f.owner <> l.doc_id AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
