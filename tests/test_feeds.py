"""Three batches leave what one batch leaves, streamed or synchronised by token; repeats change nothing."""

import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.session import shared_dir
from threadloom.streaming.feeds import Feed, changes

SCHEMA = "message_id string, thread_id long, sender string, text string, tag string, history_id long"
ROWS = [
    ("a1", 1, "ann", "we decided", "none", 1), ("a2", 1, "bob", "fine", "none", 2), ("b1", 2, "cid", "we decided too", "none", 3), ("c1", 3, "dan", "decided", "none", 4),
    ("b2", 2, "ann", "salary talk", "hr", 5), ("a3", 1, "ann", "decided again", "none", 6), ("c1", 4, "dan", "decided", "none", 7), ("d1", 5, "eve", "decided", "none", 8), ("a2", 1, "bob", "decided, fine", "none", 9),
]


def events(messages):
    """A thread with a sensitive message gives none; the others one for each message that decides."""
    closed = messages.where("tag <> 'none'").select("thread_id").distinct()
    told = messages.where(F.contains(F.col("text"), F.lit("decided"))).join(closed, "thread_id", "left_anti")
    return told.select(F.concat("message_id", F.lit("/"), F.col("thread_id").cast("string")).alias("event_id"), F.array("message_id").alias("cites"), "sender")


@pytest.fixture
def feed(spark):
    return Feed(spark, f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}", events)


def held(feed):
    return {name: sorted(tuple(map(str, r)) for r in feed.read(name).select(*sorted(feed.read(name).columns)).collect()) for name in ("messages", "events")}


def last_of_each():
    return list({r[0]: r for r in ROWS}.values())


def test_batches_equal_one_batch(spark, feed):
    for n in (0, 1, 2):
        rows = spark.createDataFrame(ROWS[3 * n : 3 * n + 3], SCHEMA).drop("history_id")
        feed.apply(rows, n)
        if n == 0:
            assert len(held(feed)["events"]) == 2
        if n == 1:  # thread 2 was tagged late: its event is gone
            assert all("b1" not in r[1] for r in held(feed)["events"])
    whole = Feed(spark, feed.root + "-whole", events)
    whole.apply(spark.createDataFrame(last_of_each(), SCHEMA).drop("history_id"), 0)
    assert held(feed) == held(whole)
    before = held(feed)
    feed.apply(spark.createDataFrame(ROWS[:3], SCHEMA).drop("history_id"), 2)  # comes again
    assert held(feed) == before


def test_sync_by_token(spark, feed):
    source = spark.createDataFrame(ROWS, SCHEMA)
    assert feed.sync(source.where("history_id <= 4")) == 0 and feed.state()["token"] == 4
    assert feed.sync(source.where("history_id <= 4")) == -1
    assert feed.sync(source.where("history_id <= 7")) == 1 and feed.sync(source) == 2 and feed.state() == {"batch": 2, "token": 9}
    whole = Feed(spark, feed.root + "-whole", events)
    whole.apply(spark.createDataFrame(last_of_each(), SCHEMA).drop("history_id"), 0)
    assert held(feed) == held(whole)
    assert changes(source.limit(0), 7)[1] == 7 and changes(source.limit(0), None)[1] is None


def test_stream(spark, feed):
    folder = feed.root + "-in"
    for n in (0, 1, 2):
        spark.createDataFrame(ROWS[3 * n : 3 * n + 3], SCHEMA).drop("history_id").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA.rsplit(",", 1)[0]).option("maxFilesPerTrigger", 1).parquet(folder)
    feed.follow(stream).trigger(availableNow=True).start().awaitTermination(120)
    whole = Feed(spark, feed.root + "-whole", events)
    whole.apply(spark.createDataFrame(last_of_each(), SCHEMA).drop("history_id"), 0)
    assert held(feed) == held(whole)
