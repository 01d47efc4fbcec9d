"""Sharding by size-tiered compaction with versioned manifests.

Each arrival is appended as a run of small immutable Parquet shards. Runs are
put into tiers by size, a factor of ``ratio`` apart; when ``fanout`` runs share a
tier they are merged into one run whose shards have the target size. The store's
state is a manifest, a JSON file with a version number that names the live runs
and the schema. A commit writes the next number's manifest under another name and
then gives it its own, which fails if another writer has done so; that one's
version is read and the change is tried again on it. A reader sees a whole version
or the one before. Nothing is changed in place: what a version no longer names
stays readable until :meth:`ShardStore.vacuum`, which keeps the newest versions and
whatever is younger than a grace period, such as a run not yet committed.

Merging rewrites rows with Spark's reader and writer, without a shuffle; a row
is rewritten once for each tier it climbs, so about the logarithm of the data.

Defined results. Rows are kept as they come: nulls, repeated rows, empty and
very long texts. Columns that only later arrivals have are added to the schema and
null in earlier rows; a column of another type raises ValueError before anything
is written. An empty arrival adds its columns but no run. A merge in which an
executor is lost is done again by Spark; one whose driver is lost leaves the old
version in force.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.llm.common import fresh
from loomwise.session import scratch_path

#: Times that a commit is tried, and the seconds that vacuum leaves alone.
TRIES, GRACE = 20, 24 * 3600.0


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    """A store below ``root``, a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 3, ratio: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.ratio = target_bytes, fanout, ratio
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("manifests"))

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join([self.root, *parts]))

    # -- versions ---------------------------------------------------------
    def version(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        text = self.spark.read.text(f"{self.root}/manifests/v{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, manifest: dict) -> None:
        """Publish the next version, or raise Conflict if its number is taken."""
        name = f"v{manifest['version']:08d}.json"
        temp, final = self._path("manifests", f".{name}.{uuid.uuid4().hex}"), self._path("manifests", name)
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":  # renaming would overwrite; a link does not
                os.link(temp.toUri().getPath(), final.toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)
                self.hadoop.FileContext.getFileContext(temp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, final, none)
        except Exception:
            if self.fs.exists(final):
                raise Conflict(name) from None
            raise
        finally:
            self.fs.delete(temp, False)

    def _change(self, change: Callable[[dict], dict]) -> None:
        """Commit a change of the newest manifest, on the one of another writer if that came first."""
        for n in range(TRIES):
            now = self.manifest()
            try:
                return self.commit(change(now) | {"version": now["version"] + 1})
            except Conflict:
                if n + 1 == TRIES:
                    raise
                time.sleep(0.01 * 2 ** min(n, 7))

    # -- runs -------------------------------------------------------------
    def _run(self, name: str) -> dict | None:
        shards = [s for s in self.fs.listStatus(self._path("runs", name)) if s.getPath().getName().startswith("part-")]
        sizes = {s.getPath().getName(): s.getLen() for s in shards}
        return {"name": name, "bytes": sum(sizes.values()), "shards": sizes} if sizes else None

    def _write(self, df: DataFrame) -> dict | None:
        name = uuid.uuid4().hex[:16]
        df.write.parquet(f"{self.root}/runs/{name}")
        return self._run(name)

    def tier(self, run: dict) -> int:
        """0 around the target size, one more for each factor of ratio above it, one less for each below."""
        return math.ceil(math.log(max(1, run["bytes"]) / self.target_bytes, self.ratio))

    @staticmethod
    def _with(schema: dict | None, more: T.StructType) -> dict:
        """A schema with the columns of another; Spark tells no case apart."""
        fields = {f.name.lower(): f for f in T.StructType.fromJson(schema)} if schema else {}
        for f in more:
            known = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
            if known.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name}: the store has {known.dataType.simpleString()}, the arrival {f.dataType.simpleString()}")
        return T.StructType(list(fields.values())).jsonValue()

    def append(self, arrival: DataFrame) -> None:
        """Add an arrival as a run."""
        self._with(self.manifest()["schema"], arrival.schema)
        run = self._write(arrival)
        if run and self.spark.read.parquet(f"{self.root}/runs/{run['name']}").isEmpty():
            run = None
        self._change(lambda now: now | {"schema": self._with(now["schema"], arrival.schema), "runs": now["runs"] + [run] * (run is not None)})

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version and in a last column the run and file that hold the row: _shard, or with more underscores if the rows have that."""
        now = self.manifest(version)
        schema = T.StructType.fromJson(now["schema"]) if now["schema"] else T.StructType()
        paths = [f"{self.root}/runs/{r['name']}" for r in now["runs"]]
        (shard,) = fresh(schema.names, "_shard")
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*paths)
        # rows may have a column _metadata of their own
        file = rows.metadataColumn("_metadata")["file_path"]
        return rows.withColumn(shard, F.element_at(F.split(file, "/runs/"), -1))

    def _mergeable(self, runs: list[dict]) -> list[dict]:
        by: dict[int, list[dict]] = {}
        for r in runs:
            by.setdefault(self.tier(r), []).append(r)
        return next((by[t] for t in sorted(by) if len(by[t]) >= self.fanout), [])

    def merge(self, runs: list[dict]) -> None:
        """Merge runs into one with shards of the target size, and commit that; Conflict if one is no longer live."""
        paths = [f"{self.root}/runs/{r['name']}" for r in runs]
        n = max(1, round(sum(r["bytes"] for r in runs) / self.target_bytes))
        new = self._write(self.spark.read.schema(T.StructType.fromJson(self.manifest()["schema"])).parquet(*paths).coalesce(n))
        gone = {r["name"] for r in runs}

        def swapped(now: dict) -> dict:
            if not gone <= {r["name"] for r in now["runs"]}:
                raise LookupError
            return now | {"runs": [r for r in now["runs"] if r["name"] not in gone] + [new]}

        try:
            self._change(swapped)
        except LookupError:
            self.fs.delete(self._path("runs", new["name"]), True)
            raise Conflict("a run that was merged is no longer live") from None

    def compact(self, vacuum: bool = False, **kw) -> int:
        """Merge until no tier holds fanout runs; the number of merges."""
        n = 0
        while runs := self._mergeable(self.manifest()["runs"]):
            self.merge(runs)
            n += 1
            if vacuum:
                self.vacuum(**kw)
        return n

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> None:
        """Delete manifests but the newest ``keep``, and runs that those don't name, if older than ``grace`` seconds.

        A grace of 0 is for a store with one writer: a run not yet committed would go.
        """
        before = (time.time() - grace) * 1000
        kept = range(max(1, self.version() - keep + 1), self.version() + 1)
        names = {f"v{v:08d}.json" for v in kept}
        live = {r["name"] for v in kept for r in self.manifest(v)["runs"]}
        for folder, stay in (("runs", live), ("manifests", names)):
            if self.fs.exists(self._path(folder)):
                for s in self.fs.listStatus(self._path(folder)):
                    if s.getPath().getName() not in stay and s.getModificationTime() <= before:
                        self.fs.delete(s.getPath(), True)


def arrivals(docs: DataFrame, n: int = 4) -> list[DataFrame]:
    """n parts by a hash of doc_id, as if they had come one after the other."""
    return [docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(n)), F.lit(0)) == k) for k in range(n)]


def op9_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, scratch_path(spark, "store"), target_bytes=32 << 20)
    for a in arrivals(docs):
        store.append(a)
        store.compact(vacuum=True, grace=0)  # this query's own store
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS text_bytes, sha256(text) AS text_sha256 FROM documents
"""
