"""Arrivals whose columns have the names that the store or Spark uses."""

from loomwise.llm.shards import ShardStore
from loomwise.session import scratch_path


def test_columns_named_as_the_stores_own(spark):
    store = ShardStore(spark, scratch_path(spark, "store"))
    store.append(spark.createDataFrame([(1, "mine", "m")], "doc_id long, _shard string, _metadata string"))
    store.append(spark.createDataFrame([(2, "also", "n")], "doc_id long, _shard string, _metadata string"))
    got = sorted(tuple(r) for r in store.read().select("doc_id", "_shard", "_metadata").collect())
    assert got == [(1, "mine", "m"), (2, "also", "n")]
    assert store.read().columns == ["doc_id", "_shard", "_metadata", "__shard"]
    assert all(r["__shard"].endswith(".parquet") for r in store.read().collect())
