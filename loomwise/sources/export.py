"""Files that tasks write: copies by grade, sidecars and texts; and fingerprints of what files hold."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.functions.scalar import extension, file_name
from loomwise.operators.store import numbered_by
from loomwise.session import forget, materialised

COPIED, SKIPPED, ERROR = "copied", "skipped", "error"
#: Bytes that a task holds of a file, and of a leaf of a fingerprint.
CHUNK = 1 << 20
#: Files that a task copies or reads at most, names that it hands on at once, and what the names of files being written begin with.
FILES, NAMES, WRITING = 2000, 10_000, ".writing-"
#: Bytes of files' contents that a task hands on at once, if a file is no larger.
HELD = 16 * CHUNK


def _places() -> Callable[[str], tuple]:
    """A function from a path, with or without a scheme, to its file system and the path there.

    Names are taken as they are, whatever signs of an URI they hold; a file system is
    opened once a scheme and host.
    """
    from pyarrow import fs

    known: dict[str, tuple] = {}

    def place(path: str) -> tuple:
        scheme, host, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?)?(/.*)?", path, re.DOTALL).groups()
        root = f"{scheme or 'file'}://{host or ''}/"
        if root not in known:
            known[root] = fs.FileSystem.from_uri(root)
        of, base = known[root]
        return of, base.rstrip("/") + (rest or "/")

    return place


def spread(df: DataFrame, by: str) -> DataFrame:
    """Rows that name files, dealt to tasks by their number: such rows are few bytes, and by bytes a task would get them all."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // FILES))
    return df.repartition(tasks, by)


def _put(rows: DataFrame, wanted: Column) -> DataFrame:
    """outcome and error of each row, once its file is written: to ``target`` from ``source``, or from ``content`` where that stands.

    A task writes a file under a name of its own attempt and renames it when it is
    whole. An attempt that is repeated renames the same bytes to the same place, so
    one copy is left, and a file is never seen in part. Where a task writes several
    files to a folder, it does so in a folder of its own inside, as tasks that make
    names in one folder wait for each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, mine = _places(), f"{WRITING}{TaskContext.get().taskAttemptId()}"
        made: dict[str, str] = {}  # folder to where its files are written
        own: list[tuple] = []

        def write(source: str | None, target: str, content: str | None) -> None:
            to, path = place(target)
            folder = path.rpartition("/")[0]
            if folder not in made:
                to.create_dir(folder, recursive=True)
                made[folder] = f"{folder}/{mine}"
            elif made[folder] == f"{folder}/{mine}":
                to.create_dir(f"{folder}/{mine}.d")
                own.append((to, f"{folder}/{mine}.d"))
                made[folder] = f"{folder}/{mine}.d/file"
            temp = made[folder]
            with to.open_output_stream(temp) as out:
                if content is not None:
                    out.write(content.encode("utf-8"))
                else:
                    of, at = place(source)
                    with of.open_input_stream(at) as data:
                        while part := data.read(CHUNK):
                            out.write(part)
            to.move(temp, path)

        for b in batches:
            outcome, error = [], []
            for source, target, content, ok in zip(*(b.column(c).to_pylist() for c in ("source", "target", "content", "wanted")), strict=True):
                try:
                    if ok:
                        write(source, target, content)
                    outcome.append(COPIED if ok else SKIPPED)
                    error.append(None)
                except Exception as e:  # a row that can't be written is told of, and the others go on
                    outcome.append(ERROR)
                    error.append(f"{type(e).__name__}: {e}"[:300])
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("target"), pa.array(outcome), pa.array(error, pa.string())], ["source", "target", "outcome", "error"])
        for to, folder in own:
            to.delete_dir(folder)

    text = F.col("content") if "content" in rows.columns else F.lit(None).cast("string")
    done = rows.select("source", "target", text.alias("content"), wanted.alias("wanted")).mapInArrow(run, "source string, target string, outcome string, error string")
    return materialised(done, "written")  # the files are written once, whatever is asked of the report


def _there(df: DataFrame, path: str) -> DataFrame:
    """df with ``there``, whether the file at ``path`` exists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places()
        for b in batches:
            found = []
            for p in b.column(path).to_pylist():
                try:
                    of, at = place(p)
                    found.append(of.get_file_info(at).is_file)
                except Exception:  # no such place
                    found.append(False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, "there"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, there boolean")


def listed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path and size of all files below folders; files that are being written are left out, and a folder that isn't there is empty.

    Folders are listed in tasks, a level at a time: a folder is one call of its file
    system, so a task holds the names of one folder, the driver none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place = _places()
        for b in batches:
            for folder in b.column("path").to_pylist():
                of, at = place(folder)
                found = of.get_file_info(fs.FileSelector(at, allow_not_found=True))
                for k in range(0, len(found), NAMES):
                    part = [f for f in found[k : k + NAMES] if not f.base_name.startswith(WRITING)]
                    names = pa.array([f"{folder.rstrip('/')}/{f.base_name}" for f in part], pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array([f.size if f.is_file else None for f in part], pa.int64())], ["path", "size"])

    level, files = spark.range(1).select(F.explode(F.array(*map(F.lit, folders)).cast("array<string>")).alias("path")), []
    while True:
        # names are few bytes, so the number of tasks is set
        here = materialised(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, "path string, size long"), "listed")
        files.append(here.where("size IS NOT NULL"))
        level = here.where("size IS NULL").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, files)


def _of_files(df: DataFrame, path: str, name: str, kind: pa.DataType, value: Callable) -> DataFrame:
    """df with a column of what ``value`` makes of the file at ``path``, given open; a task has FILES of them, and hands on HELD bytes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places()
        for b in batches:
            out, held = [], 0
            for k, p in enumerate(b.column(path).to_pylist()):
                of, at = place(p)
                with of.open_input_stream(at) as data:
                    out.append(value(data))
                held += len(out[-1])
                if held >= HELD or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(k + 1 - len(out), len(out)).columns, pa.array(out, kind)], [*b.schema.names, name])
                    out, held = [], 0

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return spread(df, path).mapInArrow(run, f"{kinds}, {name} {kind}")


def digests(df: DataFrame, path: str = "path") -> DataFrame:
    """df with ``sha256`` of the file at ``path``, which is read in chunks."""

    def total(data) -> str:
        out = hashlib.sha256()
        while part := data.read(CHUNK):
            out.update(part)
        return out.hexdigest()

    return _of_files(df, path, "sha256", pa.string(), total)


def contents(df: DataFrame, path: str = "path") -> DataFrame:
    """df with ``content``, the bytes of the file at ``path``."""
    return _of_files(df, path, "content", pa.binary(), lambda data: data.read())


def free_names(df: DataFrame, folder: str, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """df with ``final``, a name that no other row of its folder has: the first by ``order`` keeps its own, others get _1, _2 and so on.

    ``taken`` has names (folder, name) that are there already. A made name may be
    another row's own; then that one keeps it, and rounds go on until all differ.
    Rows of a name are numbered over ranges, so one name may have most rows.
    """
    stem, ext = F.regexp_replace("_now", r"\.[^.]*$", ""), F.regexp_extract("_now", r"(\.[^.]*)$", 1)
    rows = df.withColumns({"_now": F.col(name), "_turn": F.lit(1)})
    if taken is not None:
        held = taken.select(F.col("folder").alias(folder), F.col("name").alias("_now"), F.lit(0).alias("_turn"))
        rows = rows.unionByName(held, allowMissingColumns=True)
    rows = materialised(rows, "names")
    while True:
        ranked = numbered_by(rows, [folder, "_now"], ["_turn", order], "_r")
        clash = (F.col("_r") > 0) & (F.col("_turn") > 0)
        made = F.when(clash, F.concat(stem, F.lit("_"), F.col("_r").cast("string"), ext)).otherwise(F.col("_now"))
        now = materialised(ranked.withColumns({"_now": made, "_turn": F.when(clash, F.col("_turn") + 1).otherwise(F.col("_turn")), "_moved": clash}).drop("_r"), "names")
        forget(rows)
        rows = now
        if not rows.where("_moved").limit(1).count():
            return rows.where("_turn > 0").withColumn("final", F.col("_now")).drop("_now", "_turn", "_moved")
        rows = rows.drop("_moved")
        rows.scratch = now.scratch


def export_files(df: DataFrame, dest: str, grades: list[str]) -> DataFrame:
    """Copy the files of rows (path, grade) with one of the grades to ``dest``/grade: source, target, outcome and error of each row.

    Rows of other grades are skipped; a missing file, or one that can't be copied,
    is an error. No file that is there is overwritten.
    """
    rows = df.select(F.col("path").alias("source"), "grade", F.col("grade").isin(grades).alias("_w"))
    rows = materialised(_there(rows.withColumn("_w", F.coalesce("_w", F.lit(False))), "source"), "found")
    good = rows.where("_w AND there").select("source", "grade", file_name(F.col("source")).alias("name"))
    old = listed(df.sparkSession, [f"{dest.rstrip('/')}/{g}" for g in dict.fromkeys(grades)])
    taken = old.select(F.element_at(F.split("path", "/"), -2).alias("folder"), file_name(F.col("path")).alias("name"))
    named = free_names(good, "grade", "name", "source", taken)
    target = F.concat_ws("/", F.lit(dest.rstrip("/")), "grade", "final").alias("target")
    none = F.lit(None).cast("string")
    done = _put(spread(named.select("source", target), "target"), F.lit(True))
    rest = rows.where("NOT (_w AND there)").select("source", none.alias("target"), F.when(F.col("_w"), ERROR).otherwise(SKIPPED).alias("outcome"), F.when(F.col("_w"), F.lit("no such file")).alias("error"))
    return done.unionByName(rest)


def counts(report: DataFrame) -> DataFrame:
    """One row: copied, skipped and errors."""
    return report.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in ((COPIED, "copied"), (SKIPPED, "skipped"), (ERROR, "errors"))])


def write_texts(df: DataFrame, path: str, text: str) -> DataFrame:
    """Write each row's text to the file at its path, and report."""
    return _put(df.select(F.lit(None).cast("string").alias("source"), F.col(path).alias("target"), F.coalesce(text, F.lit("")).alias("content")), F.lit(True))


def _xml(c: Column) -> Column:
    out = c
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def xmp(score: Column, grade: Column, critique: Column, breakdown: Column) -> Column:
    """The text of an XMP sidecar: rating from 0 to 5, description, label and nickname; texts are escaped."""
    rating = F.least(F.greatest(F.bround(F.coalesce(score, F.lit(0.0)) * 5), F.lit(0)), F.lit(5)).cast("int").cast("string")
    # fixed values: the names and frame of the format
    tags = [("xmp:Rating", rating), ("dc:description", critique), ("xmp:Label", grade), ("xmp:Nickname", breakdown)]
    body = F.concat_ws("\n      ", *[F.concat(F.lit(f"<{t}>"), _xml(F.coalesce(v, F.lit(""))), F.lit(f"</{t}>")) for t, v in tags])
    head = '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n    <rdf:Description rdf:about=""\n      xmlns:xmp="http://ns.adobe.com/xap/1.0/"\n      xmlns:dc="http://purl.org/dc/elements/1.1/">\n      '
    tail = '\n    </rdf:Description>\n  </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>'
    return F.concat(F.lit(head), body, F.lit(tail))


def write_sidecars(df: DataFrame, dest: str, kind: str = "xmp") -> DataFrame:
    """Write a sidecar for each row (path, score, grade, critique, breakdown as JSON) below ``dest``, and report.

    xmp, or json with the row's fields. A sidecar has its file's name with another
    ending; equal names get _1, _2 and so on.
    """
    if kind == "xmp":
        text = xmp(F.col("score"), F.col("grade"), F.col("critique"), F.col("breakdown"))
    else:
        text = F.to_json(F.struct("path", "score", "grade", "critique", "breakdown"), {"ignoreNullFields": "false"})
    name = F.concat(F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", ""), F.lit(f".{kind}"))
    rows = df.select("path", text.alias("content"), name.alias("name"), F.lit("").alias("folder")).withColumn("_row", F.monotonically_increasing_id())
    rows = materialised(rows, "sidecars")
    # names are settled without the texts, which are written and shuffled once
    named = free_names(rows.drop("content"), "folder", "name", "path").select("_row", "final")
    out = rows.join(named, "_row").select(F.col("path").alias("source"), F.concat_ws("/", F.lit(dest.rstrip("/")), "final").alias("target"), "content")
    return _put(out, F.lit(True))


def fingerprints(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, size and fingerprint of the files of rows (path, size) by what they hold, whatever their names and times.

    Only files that share their size with another are read: a size that no other
    file has tells a file apart by itself, and files without a byte are alike. The
    others' content is hashed in chunks in tasks, and the chunks' hashes are hashed
    in order. The driver holds neither names nor sizes.
    """

    def total(data) -> str:
        out = hashlib.sha256()
        while part := data.read(chunk):
            while len(part) < chunk and (more := data.read(chunk - len(part))):  # a stream may give less than it is asked for
                part += more
            out.update(hashlib.sha256(part).hexdigest().encode())
        return out.hexdigest()

    found = materialised(found.select("path", "size").dropDuplicates(["path"]), "found")
    sizes = found.groupBy("size").count().select("size", ((F.col("count") > 1) & (F.col("size") > 0)).alias("_read"))
    found = materialised(found.join(sizes, "size").select("path", "size", "_read"), "found")
    alone = found.where("NOT _read").select("path", "size", F.concat(F.lit("size-"), "size").alias("fingerprint"))
    return alone.unionByName(_of_files(found.where("_read").select("path", "size"), "path", "fingerprint", pa.string(), total))


def content_fingerprints(spark: SparkSession, folders: list[str], extensions: list[str], recursive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """:func:`fingerprints` of the files below folders that Spark's reader finds.

    It leaves out files without a byte and hidden ones, and lists in the driver, which
    holds all files' statuses; ``listed`` finds all files, in tasks.
    """
    # loaded once: each load lists all files, and the driver gets the list
    files = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(f) for f in folders])
    return fingerprints(files.where(extension(F.col("path")).isin(extensions)).select("path", F.col("length").alias("size")), chunk)
