"""What language-model scoring learns from: training texts alone, whatever held-out texts say; no task has most events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwise.llm import lm_score

KIND = "doc_id long, text string, held_out boolean"


def rows(n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    return [(d, " ".join(words[int(x)] for x in rng.zipf(1.6, 50) % 40), d % 5 == 0) for d in range(n)]


def scored(spark, data, shard=lm_score.SHARD):
    docs = spark.createDataFrame(data, KIND)
    model, counts = lm_score.train(spark, docs.where(~F.col("held_out")), shard=shard)
    return {r["doc_id"]: r["score"] for r in lm_score.score(spark, docs, model, counts).collect()}


@pytest.mark.parametrize("shard", [lm_score.SHARD, 500])
def test_held_out_texts_change_no_training_score(spark, shard):
    data = rows()
    other = [(d, " ".join(reversed((t + " w1 w1 w2 unseen words " * (d + 1)).split())) if h else t, h) for d, t, h in data]
    a, b = scored(spark, data, shard), scored(spark, other, shard)
    for d, _, h in data:
        assert h or a[d] == pytest.approx(b[d], abs=1e-4)
    assert any(abs(a[d] - b[d]) > 1 for d, _, h in data if h)


def test_pairs_that_were_not_learned_have_the_rest(spark):
    """By plain sums: the probabilities of all units of a class after a word add up to 1, learned or not."""
    docs = spark.createDataFrame(rows(), KIND)
    model, _ = lm_score.train(spark, docs.where(~F.col("held_out")))
    units = np.arange(len(model.cls))
    pair = np.uint64(77) << np.uint64(lm_score.UNIT) | units.astype(np.uint64)
    n = np.where(units % 3 == 0, units % 7, 0)
    inside = np.exp(lm_score._inside(pair, n, model))
    for k in range(model.classes.n):
        own = model.cls == k
        assert inside[own].sum() == pytest.approx(1)
    assert np.exp(lm_score._inside(pair, n * 0, model)) == pytest.approx(model.share)


def test_the_order_of_events_is_their_own():
    rng = np.random.default_rng(2)
    n = 5000
    last, unit = rng.integers(0, 50, n).astype(np.uint32), rng.integers(0, 30, n).astype(np.int32)
    f = [rng.integers(0, 9, n).astype(np.uint16) for _ in range(3)]
    order, pair, of = lm_score._ordered(last, f, unit)
    mix = rng.permutation(n)
    again, pair2, of2 = lm_score._ordered(last[mix], [x[mix] for x in f], unit[mix])
    stack = np.stack([last, unit, *f])
    assert (pair == pair2).all() and (of[mix] == of2).all()
    assert (stack[:, order] == stack[:, mix][:, again]).all()


def test_one_repeated_sentence_is_dealt_to_all_shards(spark):
    """Largest task of a table in which every document says the same."""
    data = [(d, "the same words stand in every single line of all texts", False) for d in range(4000)]
    docs = spark.createDataFrame(data, KIND)
    model, _ = lm_score.train(spark, docs, shard=2000)
    assert model.shards == 24
    key = F.xxhash64("doc_id", "text").alias("key")
    dealt = docs.select(key, "held_out", "text").mapInArrow(lm_score._deal_task(spark.sparkContext.broadcast(model)), "shard int, block long, data binary")
    events = {}
    for r in dealt.where("shard >= 0").collect():
        events[r["shard"]] = events.get(r["shard"], 0) + int(np.frombuffer(r["data"][:4], np.uint32)[0])
    assert sum(events.values()) == 4000 * 12 and max(events.values()) < 4 * 2000


def test_segment_sums():
    rng = np.random.default_rng(1)
    g = rng.normal(size=(50, 4)).astype(np.float32)
    for sizes in ([1, 1, 1], [1, 2, 3, 4, 9, 1], [7], [3, 3, 2, 2]):
        of = rng.integers(0, 50, sum(sizes))
        first = np.cumsum([0, *sizes[:-1]])
        want = np.array([g[of[a : a + n]].sum(0) for a, n in zip(first, sizes, strict=True)])
        assert lm_score._segment_sums(g, of, first) == pytest.approx(want, abs=1e-5)
