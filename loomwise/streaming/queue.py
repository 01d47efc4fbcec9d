"""A queue of feedback pairs that are delivered once, and again after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomwise.operators.layers import Layers
from loomwise.session import forget, materialised

PENDING, SENT, DEAD = "pending", "sent", "dead"


class FeedbackQueue:
    """Pairs with their state and attempts, a row for each key, kept below a folder.

    A pair that comes is pending. A delivery hands all pending pairs to ``send`` as one
    DataFrame: if it returns they are sent, if it raises their attempts are counted
    and they stay pending for the next delivery, or are dead after ``most`` attempts.
    A pair that came before is not taken again, whatever its state, so a batch that
    the stream repeats adds nothing. If the job dies between a delivery and its
    entry in the log, the same pairs are sent again: ``send`` has to take a key that
    it knows as one pair, as an upsert does.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, send: Callable[[DataFrame], None], most: int = 5):
        own = [T.StructField("state", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())]
        self.names = [f.name for f in schema]
        self.table = Layers(spark, root, T.StructType([*schema, *own]), key)
        self.key, self.send, self.most = key, send, most

    def take(self, batch: DataFrame, number: int | None = None) -> None:
        """Add pairs that the queue doesn't know."""
        fresh = batch.select(*self.names).join(self.table.read().select(self.key), self.key, "left_anti")
        self.table.upsert(fresh.withColumns({"state": F.lit(PENDING), "attempts": F.lit(0), "error": F.lit(None).cast("string")}), number, "take")

    def deliver(self) -> bool:
        """Send what is pending; whether nothing is pending any more."""
        waiting = materialised(self.table.read().where(F.col("state") == PENDING), "pending")
        try:
            if not waiting.limit(1).count():
                return True
            try:
                self.send(waiting.select(*self.names))
                after = waiting.withColumns({"state": F.lit(SENT), "error": F.lit(None).cast("string")})
            except Exception as e:
                dead = F.col("attempts") + 1 >= self.most
                after = waiting.withColumns({"state": F.when(dead, DEAD).otherwise(PENDING), "error": F.lit(str(e)[:500])})
            self.table.upsert(after.withColumn("attempts", F.col("attempts") + 1))
            return not self.table.read().where(F.col("state") == PENDING).limit(1).count()
        finally:
            forget(waiting)

    def drain(self) -> None:
        """Deliver until nothing is pending; at most ``most`` times, as pairs are dead then."""
        while not self.deliver():
            pass

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take each batch of a stream and deliver once a batch."""

        def run(batch: DataFrame, number: int) -> None:
            self.take(batch, number)
            self.deliver()

        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
