"""Files that tasks write: names that clash, repeated tasks, missing files, and what fingerprints tell apart."""

import json
import os
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from loomwise.operators import store
from loomwise.sources import export, files


def put(folder, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(folder / name), exist_ok=True)
        (folder / name).write_bytes(data)


def listed(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs if not f.startswith(".") and not f.endswith(".crc")}


def test_clashing_names_missing_files_and_a_second_export(spark, tmp_path):
    put(tmp_path / "in", {"x/a.jpg": b"xa", "y/a.jpg": b"ya", "y/a_1.jpg": b"ya1", "z/b": b"zb", "w/b": b"wb", "w/c.jpg": b"weak"})
    rows = [(str(tmp_path / "in" / p), g) for p, g in [("x/a.jpg", "Strong"), ("y/a.jpg", "Strong"), ("y/a_1.jpg", "Strong"), ("z/b", "Mid"), ("w/b", "Mid"), ("w/c.jpg", "Weak"), ("gone/d.jpg", "Mid"), ("x/a.jpg", None)]]
    df = spark.createDataFrame(rows, "path string, grade string")
    report = export.export_files(df, str(tmp_path / "out"), ["Strong", "Mid"])
    assert listed(tmp_path / "out") == {"Strong/a.jpg": b"xa", "Strong/a_1.jpg": b"ya1", "Strong/a_1_1.jpg": b"ya", "Mid/b": b"wb", "Mid/b_1": b"zb"}
    assert export.counts(report).first().asDict() == {"copied": 5, "skipped": 2, "errors": 1}
    for r in report.where("outcome = 'copied'").collect():
        assert open(r["target"], "rb").read() == open(r["source"], "rb").read()
    before = listed(tmp_path / "out")
    again = export.export_files(df.where("grade = 'Mid'"), str(tmp_path / "out"), ["Mid"])
    after = listed(tmp_path / "out")
    assert len(after) == 7 and all(after[k] == v for k, v in before.items()) and export.counts(again).first()["copied"] == 2


def test_a_task_that_runs_again_leaves_one_copy(spark, tmp_path):
    put(tmp_path, {"in/a": b"data"})
    rows = spark.createDataFrame([(str(tmp_path / "in/a"), str(tmp_path / "out/a"))], "source string, target string")
    for _ in range(2):
        assert export._put(rows, F.lit(True)).first()["outcome"] == "copied"
    assert sorted(os.listdir(tmp_path / "out")) == ["a"] and listed(tmp_path / "out") == {"a": b"data"}


def test_one_name_for_most_rows(spark):
    df = spark.range(5000).select(F.lit("f").alias("folder"), F.when(F.col("id") < 4900, "same.txt").otherwise(F.concat(F.lit("same_"), "id", F.lit(".txt"))).alias("name"), "id")
    got = export.free_names(df, "folder", "name", "id")
    assert got.select("final").distinct().count() == 5000
    first = {r["id"]: r["final"] for r in got.where("id in (0, 1, 4999)").collect()}
    assert first == {0: "same.txt", 1: "same_1.txt", 4999: "same_4999.txt"}


def test_numbers_in_groups(spark):
    rows = [(i, ["a", None, "b"][i % 3] if i % 10 else "hot") for i in range(300)]
    got = store.numbered_by(spark.createDataFrame(rows, "i long, g string").repartition(5), ["g"], ["i"]).collect()
    want, seen = {}, {}
    for i, g in rows:
        want[i] = seen[g] = seen.get(g, -1) + 1
    assert {r["i"]: r["n"] for r in got} == want
    assert store.numbered_by(spark.createDataFrame([], "i long, g string"), ["g"], ["i"]).count() == 0


def test_sidecars_of_both_kinds(spark, tmp_path):
    rows = [("x/a.jpg", 0.9, "Strong", "crisp <edges> & depth", '{"tech": 1}'), ("y/a.png", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, score double, grade string, critique string, breakdown string")
    assert export.counts(export.write_sidecars(df, str(tmp_path / "xmp"))).first()["copied"] == 2
    files = listed(tmp_path / "xmp")
    assert set(files) == {"a.xmp", "a_1.xmp"}
    tree = ET.fromstring(files["a.xmp"].decode("utf-8").split("?>", 1)[1].rsplit("<?xpacket", 1)[0])
    text = {e.tag.rsplit("}", 1)[-1]: e.text for e in tree.iter()}
    assert text["Rating"] == "4" and text["description"] == "crisp <edges> & depth" and text["Label"] == "Strong"
    assert "<xmp:Rating>0</xmp:Rating>" in files["a_1.xmp"].decode()
    export.write_sidecars(df, str(tmp_path / "json"), "json").count()
    assert json.loads(listed(tmp_path / "json")["a_1.json"]) == {"path": "y/a.png", "score": None, "grade": None, "critique": None, "breakdown": None}


def test_fingerprints_follow_content_alone(spark, tmp_path):
    same = bytes(range(256)) * 9
    put(tmp_path, {"a/1.bin": same, "b/2.bin": same, "b/3.bin": same[:-1] + b"x", "c/4.bin": same[1:] + same[:1], "c/5.bin": b"", "c/7.bin": b"alone", "c/8.txt": same})
    os.utime(tmp_path / "b/2.bin", (1, 1))
    for chunk in (100, 256, 2304, 1 << 20):
        got = {os.path.basename(r["path"]): r["fingerprint"] for r in export.content_fingerprints(spark, [str(tmp_path)], ["bin"], chunk=chunk).collect()}
        assert got["1.bin"] == got["2.bin"] and got["7.bin"] == "size-5"
        assert len(set(got.values())) == 4 and len(got) == 5
    twice = export.content_fingerprints(spark, [str(tmp_path / "a"), str(tmp_path / "a")], ["bin"])
    assert twice.count() == 1


def test_documents_that_are_missing_or_damaged(spark, tmp_path):
    gone = str(tmp_path / "none.json")
    assert files.saved_sequences(spark, gone).count() == files.presets(spark, gone).count() == files.used_paths(spark, gone).count() == 0
    put(tmp_path, {"s/1.json": b'{"sequences": [{"name": "a", "paths": ["x", "y"]}, {"name": "b", "paths": []}]}', "s/2.json": b'{"sequences": [', "u/1.json": b'["p", "q", null, "p"]', "u/2.json": b"no list", "w/1.json": b'{"slow": {"flow": 0.5, "time": 1}, "none": {}}'})
    assert sorted(tuple(r) for r in files.saved_sequences(spark, str(tmp_path / "s")).collect()) == [("a", 0, "x"), ("a", 1, "y")]
    assert sorted(r["path"] for r in files.used_paths(spark, str(tmp_path / "u")).collect()) == ["p", "q"]
    assert sorted(tuple(r) for r in files.presets(spark, str(tmp_path / "w")).collect()) == [("slow", "flow", 0.5), ("slow", "time", 1.0)]


def test_sqlite_files_of_many_tasks(spark, tmp_path):
    rows = [(f"p{i}", [float(i), 0.5], [None, 0.0, 0.7][i % 3], [None, "", "Strong"][i % 3], None if i % 2 else float(i)) for i in range(40)]
    df = spark.createDataFrame([*rows, ("null", None, None, None, None)], "path string, embedding array<float>, score double, grade string, exif_ts double").repartition(4)
    told = files.write_sqlite(df, str(tmp_path / "db"), "e")
    assert sum(r["rows"] for r in told.collect()) == 41 and sorted(os.listdir(tmp_path / "db")) == [f"part-{k:06d}.db" for k in range(4)]
    got = {r["path"]: r for r in files.sqlite_folder(spark, told, "e").collect()}
    assert len(got) == 41 and got["null"]["embedding"] is None
    for p, e, s, g, t in rows:
        assert (got[p]["embedding"], got[p]["score"], got[p]["grade"], got[p]["exif_ts"]) == (e, s or 0.5, g or "Mid", t or 0.0)
