"""State that goes on from batch to batch: messages by change token, and the events drawn from their threads.

Each batch writes new versions of its tables and then one row that names them, so a batch that is
cut off or comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import replace_scoped, upsert

Derive = Callable[[DataFrame], DataFrame]


def changes(rows: DataFrame, token: int | None, at: str = "history_id") -> tuple[DataFrame, int | None]:
    """The rows after a token (all without one), and the token to go on from; it stays if there are none."""
    new = rows if token is None else rows.where(F.col(at) > token)
    last = new.agg(F.max(at)).first()[0]
    return new, token if last is None else last


class Feed:
    """Versioned tables of messages and events in a shared folder.

    ``derive`` draws events (event_id, cites and more) from the messages of whole threads; ``keys``
    name a message, ``thread`` its thread.  ``late`` rows of a message replace the earlier one.
    """

    def __init__(self, spark: SparkSession, root: str, derive: Derive, key: str = "message_id", thread: str = "thread_id"):
        self.spark, self.root, self.derive, self.key, self.thread = spark, root.rstrip("/"), derive, key, thread

    def state(self) -> dict | None:
        """The newest complete version: batch and token; None before the first."""
        try:
            done = self.spark.read.schema("batch long, token long").json(f"{self.root}/done")
            row = done.orderBy(F.desc("batch")).first()
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            row = None
        return row.asDict() if row else None

    def read(self, name: str) -> DataFrame | None:
        """``messages`` or ``events`` as the last complete batch left them."""
        now = self.state()
        return None if now is None else self.spark.read.parquet(f"{self.root}/{name}/v{now['batch']}")

    def apply(self, batch: DataFrame, batch_id: int, token: int | None = None) -> None:
        """Put a batch of messages in place and draw the events of its threads anew.

        Events that cite any message of these threads go first: a message that is tagged late takes
        what was drawn from its thread with it.  A batch that was applied already is left out.
        """
        now = self.state()
        if now is not None and now["batch"] >= batch_id:
            return
        old, events = self.read("messages"), self.read("events")
        messages = batch.dropDuplicates() if old is None else upsert(old, batch, [self.key])
        if old is None:
            messages = upsert(messages.limit(0), messages, [self.key])
        messages.write.mode("overwrite").parquet(f"{self.root}/messages/v{batch_id}")
        messages = self.spark.read.parquet(f"{self.root}/messages/v{batch_id}")
        touched = batch.select(self.thread).distinct()
        if old is not None:  # a message may have moved from another thread
            touched = touched.unionByName(old.join(batch.select(self.key), self.key, "left_semi").select(self.thread)).distinct()
        own = messages.join(touched, self.thread, "left_semi")
        drawn = self.derive(own)
        processed = own.select(F.col(self.key).alias("cite"))
        after = drawn if events is None else replace_scoped(events, drawn.select(*events.columns), "event_id", "cites", processed)
        after.write.mode("overwrite").parquet(f"{self.root}/events/v{batch_id}")
        done = self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch"), F.lit(token).cast("long").alias("token"))
        done.coalesce(1).write.mode("append").json(f"{self.root}/done")

    def sync(self, source: DataFrame, at: str = "history_id") -> int:
        """Apply what a source has after the stored token; returns the number of the batch, -1 if nothing is new."""
        now = self.state()
        new, token = changes(source, now and now["token"], at)
        if token is None or (now is not None and token == now["token"]):
            return -1
        batch_id = 0 if now is None else now["batch"] + 1
        self.apply(new.drop(at), batch_id, token)
        return batch_id

    def follow(self, stream: DataFrame):
        """A streaming query that applies each micro-batch; its checkpoint lies beside the tables."""
        return stream.writeStream.foreachBatch(lambda batch, n: self.apply(batch, n)).option("checkpointLocation", f"{self.root}/checkpoint")
