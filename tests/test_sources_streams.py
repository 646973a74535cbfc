"""Mail of unknown character sets, strict days, repeated keys, streams that run out."""

import pytest
from pyspark.sql import functions as F

from threadloom.sources import readers, sinks
from threadloom.streaming import windows


def test_unknown_character_set(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Subject: x\nContent-Type: text/plain; charset=no-such-set\n\nhello\n")
    (tmp_path / "b.eml").write_bytes(b"Subject: y\nContent-Type: text/plain; charset=utf-8\n\ncaf\xc3\xa9\n")
    got = {r.headers["Subject"]: r.body_text.strip() for r in readers.read_mime(spark, str(tmp_path)).collect()}
    assert got == {"x": "hello", "y": "café"}


@pytest.mark.parametrize("start, end", [("2020-1-01", None), ("2020-02-30", None), (None, "01.02.2020"), ("2020-02-02", "2020-02-01")])
def test_days_are_strict(spark, start, end):
    with pytest.raises(ValueError):
        readers.in_window(spark.range(1).select(F.current_timestamp().alias("ts")), "ts", start, end)


def test_repeated_keys_of_an_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, name string, n long")
    new = spark.createDataFrame([(2, "c", 5), (2, "c", 7), (3, None, 1)], old.schema)
    assert sorted(map(tuple, sinks.upsert(old, new, ["id"]).collect()), key=repr) == [(1, "a", 1), (2, "c", 7), (3, None, 1)]


def test_streamed_windows_sessions_and_upserts(spark, tmp_path):
    """What a stream leaves behind equals the same operator on the table."""
    rows = [("2024-01-01 00:00:00", 1, "view", 1.0, 1), ("2024-01-01 00:20:00", 1, "view", 2.0, 2), ("2024-01-01 02:00:00", 1, "click", 3.0, 3), ("2024-01-01 00:10:00", 2, "view", 4.0, 4), ("2024-01-01 00:10:00", 2, "view", 4.0, 4)]
    events = spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.limit(1).withColumn("ts", F.lit("2024-01-03").cast("timestamp")).withColumn("event_id", F.lit(99).cast("long"))  # closes all windows
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def out(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()), key=repr)

    for size, slide in (("1 hour", None), ("1 hour", "30 minutes")):
        want = sorted(map(tuple, windows.windowed_counts(events, size, slide).collect()), key=repr)
        assert out(windows.windowed_counts(stream(), size, slide, "10 minutes"), f"w{slide is None}".lower()) == want
    assert out(windows.sessions(stream(), late="10 minutes"), "sessions") == sorted(map(tuple, windows.sessions(events).collect()), key=repr)
    assert len(out(windows.deduplicated(stream(), ["event_id"]), "unique")) == 5
    held = {}
    merge = windows.merging(lambda: held.get("t"), lambda df: held.update(t=spark.createDataFrame(df.collect(), df.schema)), ["event_id"])
    for batch in (events, events.withColumn("value", F.lit(9.0)).where("event_id = 4"), late):
        merge(batch, 0)
    assert sorted((r.event_id, r.value) for r in held["t"].collect()) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 9.0), (99, 1.0)]
