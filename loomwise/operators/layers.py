"""A keyed table whose upserts write no more than what they bring: bucketed runs, merged when read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.operators.store import conformed

GONE = "_gone"


class Layers:
    """Runs of rows below a folder, sorted and bucketed by the key, and a log whose last entry names the live ones.

    An upsert writes one run of its own rows; of two runs with a key the newer one
    stands. A read joins each run against the newer ones by the key: all have the
    same buckets, so nothing is shuffled. Runs of similar size are merged, so that a
    row is written once for each doubling of the table and a read meets few runs.
    Deleted keys are rows of a run until it is merged with the oldest.

    The log has one writer; an entry that exists already is an error. A batch with
    an id that its source has passed before changes nothing. Keys are never null: a
    row without one is an error. ``ratio``: a run is merged with those after it once
    it has less than ``ratio`` times their rows.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 16, ratio: float = 2.0):
        self.spark, self.root, self.key, self.buckets, self.ratio = spark, root.rstrip("/"), key, buckets, ratio
        self.schema = schema
        self.stored = T.StructType([*schema, T.StructField(GONE, T.BooleanType())])
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[str]:
        p = self.hadoop.Path(f"{self.root}/log")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p) if s.getPath().getName().endswith(".json")) if self.fs.exists(p) else []

    def state(self) -> dict:
        names = self._log()
        if not names:
            return {"version": 0, "runs": [], "batches": {}}
        return json.loads(self.spark.read.text(f"{self.root}/log/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        name = f"{state['version']:08d}.json"
        temp, to = (self.hadoop.Path(f"{self.root}/log/{n}") for n in (f".{uuid.uuid4().hex}", name))
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(temp, to):
            self.fs.delete(temp, False)
            raise RuntimeError(f"another writer has made version {state['version']} of {self.root}")

    def _table(self, run: dict) -> DataFrame:
        name = f"layer_{run['dir']}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.stored)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run['dir']}'")
        return self.spark.table(name)

    def _write(self, df: DataFrame) -> dict:
        """A run of rows with one row a key."""
        run = f"r{uuid.uuid4().hex[:16]}"
        df.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.root}/{run}").saveAsTable(f"layer_{run}")
        return {"dir": run, "rows": self._table({"dir": run}).count()}

    def _merged(self, runs: list[dict]) -> DataFrame:
        """The rows of some runs, oldest first, that no newer one replaces."""
        tables = [self._table(r) for r in runs]
        out = None
        for k, t in enumerate(tables):
            for newer in tables[k + 1 :]:
                t = t.join(newer.select(self.key), self.key, "left_anti")
            t = t.select(*self.stored.names)
            out = t if out is None else out.unionByName(t)
        return out

    def read(self) -> DataFrame:
        runs = self.state()["runs"]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(runs).where(~F.col(GONE)).drop(GONE)

    def _add(self, rows: DataFrame, gone: bool, batch: int | None, source: str) -> None:
        state = self.state()
        if batch is not None and state["batches"].get(source, -1) >= batch:
            return
        key = F.when(F.col(self.key).isNull(), F.raise_error(F.lit(f"a row has no {self.key}"))).otherwise(F.col(self.key))
        rest = [c for c in self.schema.names if c != self.key]
        rows = rows.withColumn(self.key, key.cast(self.schema[self.key].dataType)).repartition(self.buckets, self.key)
        last = rows.groupBy(self.key).agg(F.max(F.struct(*rest) if rest else F.lit(0)).alias("_r"))
        run = self._write(last.select(*[self.key if c == self.key else F.col(f"_r.{c}").alias(c) for c in self.schema.names], F.lit(gone).alias(GONE)))
        runs = state["runs"] + ([run] if run["rows"] else [])
        batches = state["batches"] | ({source: batch} if batch is not None else {})
        self._commit(state | {"runs": self._compacted(runs), "batches": batches})

    def upsert(self, new: DataFrame, batch: int | None = None, source: str = "") -> None:
        """Add rows; of repeated keys in ``new`` the greatest row stands."""
        self._add(conformed(new, self.schema, {}), False, batch, source)

    def delete(self, keys: DataFrame, batch: int | None = None, source: str = "") -> None:
        self._add(conformed(keys.select(self.key), self.schema, {}), True, batch, source)

    def _compacted(self, runs: list[dict]) -> list[dict]:
        at, rows = len(runs) - 1, runs[-1]["rows"] if runs else 0
        while at > 0 and runs[at - 1]["rows"] < self.ratio * rows:
            at -= 1
            rows += runs[at]["rows"]
        if at >= len(runs) - 1:
            return runs
        merged = self._merged(runs[at:])
        return runs[:at] + [self._write(merged.where(~F.col(GONE)) if at == 0 else merged)]

    def compact(self) -> None:
        """Merge all runs into one."""
        state = self.state()
        if len(state["runs"]) > 1:
            self._commit(state | {"runs": [self._write(self._merged(state["runs"]).where(~F.col(GONE)))]})

    def vacuum(self) -> int:
        """Delete the runs that the last entry of the log doesn't name, and say how many; no other reader may be at work."""
        live = {r["dir"] for r in self.state()["runs"]}
        gone = [s.getPath() for s in self.fs.listStatus(self.hadoop.Path(self.root)) if s.isDirectory() and s.getPath().getName() not in live | {"log"}]
        for p in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS layer_{p.getName()}")
            self.fs.delete(p, True)
        return len(gone)

    def recreate_unless(self, column: str, dims: int) -> bool:
        """Drop all rows if a stored vector of ``column`` has another length than ``dims``, and say so: rows of an older model are of no use.

        Nulls fit any length. The runs stay on disk until :meth:`vacuum`.
        """
        state = self.state()
        if self.read().where(F.size(column) != dims).limit(1).count() == 0:
            return False
        self._commit(state | {"runs": []})
        return True

    def bytes(self) -> int:
        """Bytes of all files below the folder, live or not."""
        return self.fs.getContentSummary(self.hadoop.Path(self.root)).getLength()
