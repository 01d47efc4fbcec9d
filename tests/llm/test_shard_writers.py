"""Shards under two writers, added columns and vacuum."""

import pytest

from loomwise.llm import shards
from loomwise.session import scratch_path


def _store(spark, root=None):
    return shards.ShardStore(spark, root or scratch_path(spark, "store"), target_bytes=1 << 20)


def _rows(store):
    return sorted(map(tuple, store.read().drop("_shard").collect()), key=repr)


def test_two_writers_lose_nothing(spark, monkeypatch):
    a = _store(spark)
    b = _store(spark, a.root)
    one, two = (spark.createDataFrame([(k, "x")], "id long, t string") for k in (1, 2))
    first = a.manifest()
    a.append(one)
    with pytest.raises(shards.Conflict):
        b.commit(first | {"version": 1})
    real, stale = b.manifest, iter([first, first])
    monkeypatch.setattr(b, "manifest", lambda v=None: next(stale, None) or real(v))
    b.append(two)  # sees the old version first, and tries again on the new one
    assert _rows(a) == [(1, "x"), (2, "x")] and a.version() == 2
    runs = a.manifest()["runs"]
    a.merge(runs)
    with pytest.raises(shards.Conflict):
        b.merge(runs)
    assert _rows(b) == [(1, "x"), (2, "x")] and len(b.manifest()["runs"]) == 1


def test_columns_of_later_arrivals(spark):
    s = _store(spark)
    s.append(spark.createDataFrame([(1,)], "id long"))
    s.append(spark.createDataFrame([("b", 2)], "Extra string, ID long"))
    assert _rows(s) == [(1, None), (2, "b")] and s.read().columns == ["id", "Extra", "_shard"]
    version = s.version()
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([(3, 1.0)], "id long, extra double"))
    assert s.version() == version
    s.merge(s.manifest()["runs"])
    assert _rows(s) == [(1, None), (2, "b")]


def test_vacuum_spares_what_is_young_or_named(spark):
    s = _store(spark)
    for k in range(4):
        s.append(spark.createDataFrame([(k,)], "id long"))
    pending = s._write(spark.createDataFrame([(9,)], "id long"))
    s.merge(s.manifest()["runs"])
    s.vacuum()
    assert s.read(1).count() == 1 and s.fs.exists(s._path("runs", pending["name"]))
    s.vacuum(grace=-5)
    assert not s.fs.exists(s._path("runs", pending["name"])) and s.read(s.version() - 1).count() == s.read().count() == 4
    assert s.fs.listStatus(s._path("manifests")).__len__() == 2
