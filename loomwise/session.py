"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with UTC timestamps and adaptive execution, for tests and bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomwise")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) a temporary folder is made and registered.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # set once per application; a later call finds it on the context
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        known = "file://" + tempfile.mkdtemp(prefix="loomwise-")
        spark.sparkContext.setCheckpointDir(known)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    import uuid

    return os.path.join(shared_dir(spark), "loomwise", f"{name}-{uuid.uuid4().hex[:12]}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made with :func:`scratch_path`, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialised(df, name: str):
    """The same rows, written to the shared folder and read back: computed once, and columns are still pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables) -> None:
    """Delete tables of :func:`materialised` that nothing will read again."""
    for df in tables:
        remove_path(df.sparkSession, df.scratch)


def cut(df):
    """The same rows with their lineage cut: written to the shared folder once and read back."""
    return materialised(df, "cut")
