"""A table of items as immutable Parquet snapshots with a pointer, and the merges that make new snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.functions.scalar import file_name
from loomwise.session import materialised


def upsert(table: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """All rows of ``new``, and those of the table whose key it lacks; of repeated new keys the greatest row stands."""
    last = new.groupBy(key).agg(F.max(F.struct(*[c for c in table.columns if c != key])).alias("_r")).select(key, "_r.*")
    return table.join(last, key, "left_anti").unionByName(last.select(*table.columns))


def lookup(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """The table's rows with one of the keys; absent keys are left out. Spark broadcasts the keys only if they are small."""
    return table.join(keys.select(key), key, "left_semi")


def update_only(table: DataFrame, new: DataFrame, columns: list[str], key: str = "path") -> DataFrame:
    """The table's rows with columns replaced where ``new`` has the key; nothing is inserted."""
    other = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    keep = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns]
    return table.join(other, table[key] == F.col("_k"), "left").select(*keep)


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def not_graded(found: DataFrame, table: DataFrame, folder: str, least: float = 0.10) -> DataFrame:
    """Rows of a scan that the table has no grade for: none under the folder with a score of at least ``least``."""
    done = table.where(F.startswith("path", F.lit(folder)) & (F.col("score") >= least)).select("path")
    return found.join(done, "path", "left_anti")


def conformed(df: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """The columns of a schema: missing ones get their default, others are cast."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema])


def toggled(flags: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, flag) rows in exactly one of the two tables: a change adds an absent flag and removes a present one."""
    a, b = flags.select("path", "flag").distinct(), changes.select("path", "flag").distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ["path", "flag"], "full_outer")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull()).select("path", "flag")


def replaced_by_name(saved: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    return saved.join(new.select(name).distinct(), name, "left_anti").unionByName(new)


def rotated(used: DataFrame, newest: DataFrame, pool: DataFrame) -> DataFrame:
    """Used paths with the newest added, or the newest alone once all of the pool is used."""
    union = used.select("path").union(newest.select("path")).distinct()
    left = pool.select("path").distinct().join(union, "path", "left_anti").agg(F.count("*").alias("_left"))
    old = union.join(newest.select("path"), "path", "left_anti").crossJoin(F.broadcast(left)).where("_left > 0").select("path")
    return newest.select("path").distinct().union(old)


def history(df: DataFrame, keep: int = 25) -> DataFrame:
    """The last ``keep`` paths by time of generation."""
    return df.orderBy(F.desc("generated_at"), "path").limit(keep)


def numbered_by(df: DataFrame, by: list[str], order: list[str], to: str = "n") -> DataFrame:
    """Rows of each group numbered from 0 in an order, without one task for a group.

    Rows are sorted by ranges and numbered inside each; a table with a row for each
    group in each range says how many of the group come before.
    """
    ranged = materialised(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    sizes = ranged.groupBy("_part", *by).count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.select(F.col("_part").alias("_p"), *[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], "_base")
    same = F.col("_part") == F.col("_p")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    return inside.join(sizes, same).select(*df.columns, (F.col("_base") + F.col("_in")).alias(to))


def export_paths(df: DataFrame, dest: str, grades: list[str]) -> DataFrame:
    """source and target of each row with a wanted grade; a name that is taken gets _1, _2 and so on."""
    from loomwise.sources.export import free_names

    named = free_names(df.where(F.col("grade").isin(grades)).withColumn("_name", file_name(F.col("path"))), "grade", "_name", "path")
    return named.select(F.col("path").alias("source"), F.concat_ws("/", F.lit(dest), "grade", "final").alias("target"))


def numbered(df: DataFrame, *order: str, to: str = "n") -> DataFrame:
    """Rows numbered from 0 in a total order, without one task for all of them.

    Rows are sorted by ranges and written with their place in their range; a table
    with a row a range says how many rows come before it.
    """
    placed = materialised(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part, mine = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(sizes), part == F.col("_part")).withColumn(to, F.col("_base") + mine).drop("_place", "_part", "_base")


def story_names(df: DataFrame, role_pos: str) -> DataFrame:
    """NN_role_name for the frames that succeeded, in the order of the column role_pos, then path."""
    ok = numbered(df.where("ok"), role_pos, "path", to="_n")
    return ok.select("path", F.format_string("%02d_%s_%s", F.col("_n") + 1, F.lower("role"), file_name(F.col("path"))).alias("name"))


def tokens(df: DataFrame, order: str = "path") -> DataFrame:
    """The rows with a token IMG_00, IMG_01 ... in order."""
    return numbered(df, order, to="_n").withColumn("token", F.format_string("IMG_%02d", F.col("_n"))).drop("_n")


class Snapshots:
    """Versions of a table below a folder: Parquet directories and a pointer to the live one, for one writer."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        p = self.hadoop.Path(f"{self.root}/pointers")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self) -> DataFrame:
        names = [n for n in self._pointers() if n.startswith("p")]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        live = json.loads(self.spark.read.text(f"{self.root}/pointers/{names[-1]}", wholetext=True).first()[0])["dir"]
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{live}")

    def publish(self, df: DataFrame, defaults: dict[str, object] | None = None, files: int | None = None) -> None:
        """Write df as the next version; readers see it once its pointer is renamed into place."""
        name = f"data-{uuid.uuid4().hex[:12]}"
        out = conformed(df, self.schema, defaults or {})
        (out.coalesce(files) if files else out).write.parquet(f"{self.root}/{name}")
        n = len([x for x in self._pointers() if x.startswith("p")]) + 1
        temp = self.hadoop.Path(f"{self.root}/pointers/.{name}")
        stream = self.fs.create(temp, True)
        stream.write(bytearray(json.dumps({"dir": name}).encode()))
        stream.close()
        if not self.fs.rename(temp, self.hadoop.Path(f"{self.root}/pointers/p{n:08d}")):
            raise OSError(f"could not publish a version in {self.root}")

    def upsert(self, new: DataFrame, key: str = "path") -> None:
        self.publish(upsert(self.read(), conformed(new, self.schema, {}), key))

    def compact(self, files: int = 1) -> None:
        self.publish(self.read(), files=files)
