"""Sources: folders of image files with their camera metadata, catalogs, SQLite tables and positional metadata."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.functions.scalar import extension, file_name, folder

#: File extensions that are graded, and those that are shown besides.
GRADED = ["jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp"]
SHOWN = [*GRADED, "gif", "heic", "heif", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "pef", "srw"]


def scan(spark: SparkSession, folders: list[str], extensions: list[str] = GRADED, recursive: bool = False, bundles: bool = False) -> DataFrame:
    """path, modified and size of the files with one of the extensions; a file in two folders counts once.

    With ``bundles`` a folder whose own name has one of the extensions, as a table of
    many files, is one row beside the files, with its newest time and whole size. Only
    names and sizes are read: the content column is pruned.
    """
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive or bundles).lower()).load(f).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")) for f in folders]
    if not bundles:
        return reduce(DataFrame.unionByName, parts).where(extension(F.col("path")).isin(extensions)).dropDuplicates(["path"])
    placed = []
    for part, f in zip(parts, folders, strict=True):
        root = "/" + re.sub(r"^[A-Za-z0-9]+:/*", "", f).strip("/") + "/"
        start = F.locate(root, F.col("path")) + len(root)
        top = F.substring_index(F.substring("path", start, F.length("path")), "/", 1)
        deep = F.when(F.lit(recursive) & extension(F.col("path")).isin(extensions), F.col("path"))
        placed.append(part.withColumn("entry", F.when(extension(top).isin(extensions), F.concat(F.substring("path", F.lit(1), start - 1), top)).otherwise(deep)))
    found = reduce(DataFrame.unionByName, placed).where("entry IS NOT NULL").dropDuplicates(["path"])
    return found.groupBy(F.col("entry").alias("path")).agg(F.max("modified").alias("modified"), F.sum("size").alias("size"))


def listing(found: DataFrame) -> DataFrame:
    """Folder, name and path in order of path."""
    return found.select(folder(F.col("path")).alias("folder"), file_name(F.col("path")).alias("name"), "path").orderBy("path")


def fingerprint(found: DataFrame) -> DataFrame:
    """A file's size and time as one text, where reading the content would cost too much."""
    return found.withColumn("fingerprint", F.concat_ws("-", F.col("size").cast("string"), F.unix_timestamp("modified").cast("string")))


#: Sizes of the value types of a TIFF directory.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """The values of a TIFF directory by tag; rationals as floats, texts as str."""
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = _SIZES.get(kind, 1) * count
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        raw = data[place : place + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (5, 10):
            v = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        elif kind in (3, 4, 9):
            out[tag] = list(struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw))
    return out


def exif_tags(data: bytes) -> dict[str, object]:
    """Camera fields of a JPEG's bytes; an empty dict if it has none."""
    at = data.find(b"Exif\0\0")
    if not data.startswith(b"\xff\xd8") or at < 0:
        return {}
    tiff = data[at + 6 :]
    try:
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        main = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
        more = _directory(tiff, main[0x8769][0], order) if 0x8769 in main else {}
        gps = _directory(tiff, main[0x8825][0], order) if 0x8825 in main else {}
    except (KeyError, struct.error):
        return {}
    one = lambda d, tag: (d[tag][0] if isinstance(d.get(tag), list) else d.get(tag))
    # fixed values: tag numbers of the format
    return {
        "make": one(main, 271), "model": one(main, 272), "lens": one(more, 0xA434), "focal": one(more, 0x920A), "focal_35mm": one(more, 0xA405),
        "aperture": one(more, 0x829D), "exposure": one(more, 0x829A), "iso": one(more, 0x8827), "ev": one(more, 0x9204), "program": one(more, 0x8822),
        "metering": one(more, 0x9207), "white_balance": one(more, 0xA403), "flash": one(more, 0x9209), "taken": one(more, 0x9003) or one(main, 306),
        "lat": gps.get(2), "lat_ref": one(gps, 1), "lon": gps.get(4), "lon_ref": one(gps, 3),
    }


_RAW = "path string, make string, model string, lens string, focal double, focal_35mm double, aperture double, exposure double, iso double, ev double, program int, metering int, white_balance int, flash int, taken string, lat array<double>, lat_ref string, lon array<double>, lon_ref string"


def exif(files: DataFrame) -> DataFrame:
    """Camera fields of files (path, content), one row each; the formatted fields are column expressions over the raw ones."""
    from loomwise.functions import scalar as s

    schema = T._parse_datatype_string(_RAW)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p} | exif_tags(c or b"") for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows).reindex(columns=schema.names).astype(object).where(lambda d: d.notna(), None)

    raw = files.select("path", "content").mapInPandas(run, schema)
    c = F.col
    whole = lambda x: F.bround(x).cast("long").cast("string")
    place = F.format_string("%.5f, %.5f", s.degrees(c("lat"), c("lat_ref"), "S"), s.degrees(c("lon"), c("lon_ref"), "W"))
    # fixed values: names of the codes
    return raw.select(
        "path",
        s.camera_name(c("make"), c("model")).alias("camera"),
        "lens",
        F.concat(whole(c("focal")), F.lit("mm")).alias("focal"),
        F.concat(whole(c("focal_35mm")), F.lit("mm")).alias("focal_35mm"),
        F.concat(F.lit("f/"), F.format_string("%.1f", "aperture")).alias("aperture"),
        s.shutter(c("exposure")).alias("shutter"),
        whole(c("iso")).alias("iso"),
        s.exposure_bias(c("ev")).alias("ev"),
        s.coded(c("program"), {1: "Manual", 2: "Program", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative", 6: "Action", 7: "Portrait", 8: "Landscape"}).alias("program"),
        s.coded(c("metering"), {1: "Average", 2: "Center-weighted", 3: "Spot", 4: "Multi-spot", 5: "Multi-segment", 6: "Partial"}).alias("metering"),
        F.when(c("white_balance") == 0, "Auto").when(c("white_balance").isNotNull(), "Manual").alias("white_balance"),
        F.when(c("flash").bitwiseAND(F.lit(1)) == 1, "Fired").when(c("flash").isNotNull(), "No flash").alias("flash"),
        F.replace(F.element_at(F.split("taken", " "), 1), F.lit(":"), F.lit("-")).alias("date"),
        F.substring(F.try_element_at(F.split("taken", " "), F.lit(2)), 1, 8).alias("time"),
        F.when(c("lat").isNotNull() & c("lon").isNotNull(), place).alias("gps"),
        s.exif_seconds(c("taken")).alias("exif_ts"),
    )


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The photos of a catalog, one JSON document with an array of rows."""
    return spark.read.json(path, multiLine=True).select(F.explode("photos").alias("p")).select("p.*")


def flags(spark: SparkSession, path: str) -> DataFrame:
    """(path, flag) of a flags document; a kind that the document lacks has no rows."""
    one = spark.read.schema("locked array<string>, used array<string>").json(path, multiLine=True)
    kinds = F.array(*[F.struct(F.lit(k).alias("flag"), F.coalesce(k, F.array().cast("array<string>")).alias("paths")) for k in ("locked", "used")])
    return one.select(F.explode(kinds).alias("k")).select(F.explode("k.paths").alias("path"), "k.flag")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """doc, one value of a type for each JSON document at a path or below it; none where nothing is there, null for a damaged one."""
    if not _there(spark, path):
        return spark.createDataFrame([], f"doc {kind}")
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("doc"))


def saved_sequences(spark: SparkSession, path: str) -> DataFrame:
    """name, pos and path of the frames of saved sequences; of a document {"sequences": [{"name", "paths"}]}."""
    docs = _documents(spark, path, "struct<sequences:array<struct<name:string,paths:array<string>>>>")
    each = docs.select(F.explode("doc.sequences").alias("s"))
    return each.select("s.name", F.posexplode("s.paths").alias("pos", "path"))


def presets(spark: SparkSession, path: str) -> DataFrame:
    """name, key and weight of presets; of a document {name: {key: weight}}."""
    docs = _documents(spark, path, "map<string,map<string,double>>")
    return docs.select(F.explode("doc").alias("name", "weights")).select("name", F.explode("weights").alias("key", "weight"))


def used_paths(spark: SparkSession, path: str) -> DataFrame:
    """The distinct paths of documents that are lists of paths."""
    return _documents(spark, path, "array<string>").select(F.explode("doc").alias("path")).where("path IS NOT NULL").distinct()


#: What is read of a row, with the defaults for what is null, 0 or empty.
_SQLITE = "SELECT path, embedding, coalesce(nullif(score, 0), 0.5), coalesce(nullif(grade, ''), 'Mid'), coalesce(exif_ts, 0.0) FROM \"{}\""
_STORED = "path string, embedding array<float>, score double, grade string, exif_ts double"


def _sqlite_rows(path: str, query: str, *args) -> Iterator[pd.DataFrame]:
    import sqlite3

    import numpy as np

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute(query, args)
        while some := rows.fetchmany(1000):
            yield pd.DataFrame([(p, None if e is None else np.frombuffer(e, "<f4"), s, g, t) for p, e, s, g, t in some], columns=["path", "embedding", "score", "grade", "exif_ts"])


def sqlite(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    """path, embedding, score, grade and exif_ts of a SQLite table on storage that all machines share.

    Ranges of row ids are read side by side. Defaults for null, 0 and empty: 0.5, Mid and 0.0; blobs are float32.
    """
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    low, high = low or 0, high or -1
    step = max(1, -(-(high - low + 1) // parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                yield from _sqlite_rows(path, _SQLITE.format(table) + " WHERE rowid BETWEEN ? AND ?", low + int(k) * step, low + (int(k) + 1) * step - 1)

    return spark.range(0, parts, 1, parts).mapInPandas(run, _STORED)


def sqlite_folder(spark: SparkSession, files: DataFrame, table: str) -> DataFrame:
    """The same of a table in many SQLite files (path); a task reads a file as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                yield from _sqlite_rows(p, _SQLITE.format(table))

    return files.select("path").repartition(max(1, files.count())).mapInPandas(run, _STORED)


def write_sqlite(df: DataFrame, folder: str, table: str) -> DataFrame:
    """Write rows (path, embedding, score, grade, exif_ts) as SQLite files, one a task, into a folder that all machines have mounted: path, rows.

    A file is written under its attempt's name and renamed when it is whole.
    """
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        import numpy as np
        from pyspark import TaskContext

        task, n, db = TaskContext.get(), 0, None
        name = f"{folder}/part-{task.partitionId():06d}.db"
        temp = f"{name}.{task.taskAttemptId()}.tmp"
        plain = lambda v: None if v is None or v != v else v
        for b in batches:
            if db is None:
                os.makedirs(folder, exist_ok=True)
                db = sqlite3.connect(temp)
                db.execute(f'CREATE TABLE "{table}" (path TEXT, embedding BLOB, score REAL, grade TEXT, exif_ts REAL)')
            rows = ((p, None if e is None else np.asarray(e, "<f4").tobytes(), plain(s), g, plain(t)) for p, e, s, g, t in zip(b["path"], b["embedding"], b["score"], b["grade"], b["exif_ts"], strict=True))
            n += db.executemany(f'INSERT INTO "{table}" VALUES (?, ?, ?, ?, ?)', rows).rowcount
        if db is not None:
            db.commit()
            db.close()
            os.replace(temp, name)
            yield pd.DataFrame({"path": [name], "rows": [n]})

    from loomwise.session import materialised

    return materialised(df.select("path", F.col("embedding").cast("array<float>"), F.col("score").cast("double"), "grade", F.col("exif_ts").cast("double")).mapInPandas(run, "path string, rows long"), "sqlite")


def zipped(vectors: DataFrame, metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Vectors (pos, v) with parallel arrays of metadata, joined by position; what is missing is null.

    A metadata row holds the arrays from position ``first`` on, from 0 where there is no such column.
    """
    first = F.col("first") if "first" in metadata.columns else F.lit(0)
    long = metadata.select(first.alias("first"), F.posexplode(F.arrays_zip(*columns)).alias("k", "m")).select((F.col("first") + F.col("k")).alias("pos"), "m.*")
    return vectors.join(long, "pos", "left")


def first_with_rows(choices: list[DataFrame]) -> DataFrame:
    """The first of some sources that has a row, else the last."""
    return next((c for c in choices if not c.isEmpty()), choices[-1])


def fallback_rows(found: DataFrame, score: float, limit: int | None = None) -> DataFrame:
    """Files as rows with a stand-in score, for want of anything graded."""
    out = found.select("path", F.lit(score).alias("score"))
    return out.orderBy("path").limit(limit) if limit else out


def write_catalog(df: DataFrame, path: str, saved_at: str | None = None) -> None:
    """Write rows without their vectors as a new version of a catalog: photos, folders and when it was saved.

    A version is a folder of JSON lines; its description names the parents of its
    paths, and is renamed into place when all is written, which publishes the version.
    Older versions stay, so a lost driver leaves the one before in force.
    """
    import datetime
    import uuid

    spark = df.sparkSession
    name = uuid.uuid4().hex[:12]
    slim = df.drop("embedding", "v")
    slim.write.json(f"{path}/photos-{name}")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    spark.read.json(f"{path}/photos-{name}").select(folder.alias("folder")).distinct().write.json(f"{path}/folders-{name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    about = {"name": name, "saved_at": saved_at or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "schema": slim.schema.jsonValue()}
    temp = hadoop.Path(f"{path}/.{name}")
    out = fs.create(temp, False)
    out.write(bytearray(json.dumps(about).encode()))
    out.close()
    n = len(_versions(fs, hadoop, path))
    if not fs.rename(temp, hadoop.Path(f"{path}/catalog-{n:08d}-{name}.json")):
        raise OSError(f"could not publish the catalog in {path}")


def _versions(fs, hadoop, path: str) -> list[str]:
    root = hadoop.Path(path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n for n in names if n.startswith("catalog-"))


def read_catalog(spark: SparkSession, path: str, part: str = "photos") -> DataFrame:
    """The photos, or the folders, of the newest version of a catalog."""
    from pyspark.sql.types import StructType

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    about = json.loads(spark.read.text(f"{path}/{_versions(fs, hadoop, path)[-1]}", wholetext=True).first()[0])
    schema = StructType.fromJson(about["schema"]) if part == "photos" else "folder string"
    return spark.read.schema(schema).json(f"{path}/{part}-{about['name']}")


def sidecar(path: str, rating: int, score: float) -> str:
    """The text of a sidecar file."""
    return json.dumps({"path": path, "rating": rating, "score": score})
