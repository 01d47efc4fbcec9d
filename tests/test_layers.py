"""A table of layers against a dictionary, what its upserts write, and a queue whose receiver fails."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.operators.layers import Layers
from loomwise.session import scratch_path
from loomwise.streaming.queue import FeedbackQueue

KIND = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.StringType()), T.StructField("y", T.DoubleType())])


def rows(table):
    return {r["k"]: (r["x"], r["y"]) for r in table.read().collect()}


def test_upserts_and_deletes_equal_a_dictionary(spark):
    rng, table, want = random.Random(5), Layers(spark, scratch_path(spark, "layers"), KIND, "k", 4), {}
    assert rows(table) == {}
    for step in range(9):
        if step % 4 == 3:
            keys = rng.sample(range(60), 10)
            table.delete(spark.createDataFrame([(k,) for k in keys], "k long"))
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            new = [(rng.randrange(60), f"s{step}", float(rng.randrange(9)) if rng.random() < 0.8 else None) for _ in range(25)]
            table.upsert(spark.createDataFrame(new, KIND))
            for k in {r[0] for r in new}:
                want[k] = max(((x, y) for q, x, y in new if q == k), key=lambda v: (v[0], v[1] is not None, v[1] or 0))
        assert rows(table) == want
    again = Layers(spark, table.root, KIND, "k", 4)
    for r in table.state()["runs"]:
        spark.sql(f"DROP TABLE layer_{r['dir']}")  # as in another session
    assert rows(again) == want
    again.compact()
    assert again.vacuum() > 0 and rows(again) == want and len(again.state()["runs"]) == 1


def test_bytes_written_follow_the_batch(spark):
    table = Layers(spark, scratch_path(spark, "layers"), KIND, "k", 2)
    table.upsert(spark.range(300_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"), F.rand(3).alias("y")))
    base = table.bytes()
    for n in range(3):
        before = table.bytes()
        table.upsert(spark.createDataFrame([(n, "new", 1.0), (10**7 + n, "new", 2.0)], KIND))
        assert table.bytes() - before < base / 500
    assert table.read().count() == 300_003 and rows(Layers(spark, table.root, KIND, "k", 2))[1] == ("new", 1.0)
    assert len(table.state()["runs"]) == 3  # the small ones are merged with each other, not with the base


def test_a_read_shuffles_nothing(spark):
    table = Layers(spark, scratch_path(spark, "layers"), KIND, "k", 4)
    for n in (4000, 900, 100):
        table.upsert(spark.range(n).select(F.col("id").alias("k"), F.lit(f"r{n}").alias("x"), F.lit(0.0).alias("y")))
    assert len(table.state()["runs"]) == 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = table.read()
        assert df.groupBy("x").count().orderBy("x").collect() == [("r100", 100), ("r4000", 3100), ("r900", 800)]
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_batches_null_keys_and_other_writers(spark):
    table = Layers(spark, scratch_path(spark, "layers"), KIND, "k")
    one = spark.createDataFrame([(1, "a", 1.0)], KIND)
    table.upsert(one, 0, "s")
    version = table.state()["version"]
    table.upsert(spark.createDataFrame([(1, "b", 2.0)], KIND), 0, "s")
    assert rows(table) == {1: ("a", 1.0)} and table.state()["version"] == version
    table.upsert(one.where("k < 0"), 1, "s")
    assert len(table.state()["runs"]) == 1 and table.state()["batches"] == {"s": 1}
    with pytest.raises(Exception, match="a row has no k"):
        table.upsert(spark.createDataFrame([(None, "a", 1.0)], KIND))
    old = table.state()
    table.upsert(one)
    with pytest.raises(RuntimeError):
        table._commit(old)
    assert rows(table) == {1: ("a", 1.0)}


def test_rows_of_another_length_are_dropped(spark):
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    table = Layers(spark, scratch_path(spark, "layers"), kind, "path")
    assert not table.recreate_unless("v", 3)
    table.upsert(spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], kind))
    assert not table.recreate_unless("v", 2) and table.read().count() == 2
    assert table.recreate_unless("v", 3) and table.read().count() == 0 and table.vacuum() == 1
    table.upsert(spark.createDataFrame([("a", [1.0, 2.0, 3.0])], kind))
    assert not table.recreate_unless("v", 3) and table.read().count() == 1


def test_no_pair_is_lost_or_doubled_when_the_receiver_fails_twice(spark):
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.LongType())])
    received, calls = Layers(spark, scratch_path(spark, "received"), schema, "key"), []

    def send(df):
        calls.append(sorted(r["key"] for r in df.collect()))
        if len(calls) <= 2:
            raise OSError("away")
        received.upsert(df)

    q = FeedbackQueue(spark, scratch_path(spark, "queue"), schema, "key", send)
    pairs = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], schema)
    q.take(pairs("a", "b"), 0)
    assert not q.deliver()
    q.take(pairs("a", "b"), 0)  # the stream repeats its batch
    q.take(pairs("b", "c"), 1)
    assert not q.deliver()
    q.drain()
    assert calls == [["a", "b"], ["a", "b", "c"], ["a", "b", "c"]]
    assert sorted(r["key"] for r in received.read().collect()) == ["a", "b", "c"]
    got = {r["key"]: (r["state"], r["attempts"], r["error"]) for r in q.table.read().collect()}
    assert got == {"a": ("sent", 3, None), "b": ("sent", 3, None), "c": ("sent", 2, None)}
    q.take(pairs("a"), 2)
    assert q.deliver() and len(calls) == 3


def test_a_pair_that_never_arrives_is_kept_as_dead(spark):
    schema = T.StructType([T.StructField("key", T.StringType())])

    def send(df):
        raise OSError("no receiver")

    q = FeedbackQueue(spark, scratch_path(spark, "queue"), schema, "key", send, most=2)
    q.take(spark.createDataFrame([("a",)], schema))
    q.drain()
    assert [tuple(r) for r in q.table.read().collect()] == [("a", "dead", 2, "no receiver")]
