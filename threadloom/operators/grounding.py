"""Extracted events on the ground of their thread: who acted, what is cited, how sure it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scope import sole_actor

#: Kinds of events, confidence where none is given
TYPES = ("proposed", "did", "outcome")
DEFAULT_CONFIDENCE = 0.6


def actors(mentions: DataFrame, messages: DataFrame, people: DataFrame) -> DataFrame:
    """(raw_id, person): the one person that each mention (raw_id, thread_id, actor) can mean.

    An address of ``people`` (email, person) is that person.  Else the parts of the name are looked
    for in the local parts of the known senders of the thread's ``messages`` (thread_id, sender), and
    only a single person that any of them hits counts.  Case and outer white space do not matter;
    blank mentions mean nobody.
    """
    known = people.select(F.lower("email").alias("email"), "person").where("email is not null").distinct()
    asked = mentions.select("raw_id", "thread_id", F.lower(F.trim("actor")).alias("key")).where("key <> ''")
    exact = asked.join(known.withColumnRenamed("email", "key"), "key").groupBy("raw_id").agg(F.min("person").alias("person"))
    senders = messages.select("thread_id", F.lower("sender").alias("email")).distinct().join(known, "email")
    senders = senders.select("thread_id", "person", F.substring_index("email", "@", 1).alias("local")).distinct()
    parts = asked.join(exact.select("raw_id"), "raw_id", "left_anti").select("raw_id", "thread_id", F.explode(F.filter(F.split(F.translate("key", ".", " "), r"\s+"), lambda t: t != "")).alias("part"))
    met = parts.join(senders, "thread_id").where(F.contains("local", "part"))
    one = met.groupBy("raw_id").agg(F.min("person").alias("person"), F.max("person").alias("other")).where("person = other").select("raw_id", "person")
    return exact.unionByName(one)


def grounded_events(raws: DataFrame, messages: DataFrame, people: DataFrame, projects: DataFrame, owner: str | int, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(raw_id, thread_id, actor, type, summary, project, cites, confidence) of the events that stand.

    ``raws`` are raw_id, thread_id, actor (as it is mentioned), type, summary, cites (array) and
    confidence; ``messages`` message_id, thread_id, sender, text and sensitivity (array); ``projects``
    thread_id and project, the main one of each thread.  Threads with a sensitive message give
    nothing.  An event needs an actor, a known type and a citation in its thread; others are cut away,
    in order.  What the owner does needs a cited message with text and is believed less.
    """
    sensitive = messages.where(F.exists("sensitivity", lambda s: s != "none")).select("thread_id").distinct()
    told = raws.where(F.col("type").isin(*types)).join(sensitive, "thread_id", "left_anti")
    cited = told.select("raw_id", "thread_id", F.posexplode("cites").alias("at", "message_id"))
    texts = messages.groupBy("thread_id", "message_id").agg(F.max(F.trim(F.coalesce("text", F.lit(""))) != "").alias("said"))
    kept = cited.join(texts, ["thread_id", "message_id"]).groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("at", "message_id")))["message_id"].alias("cites"), F.max("said").alias("evidenced"))
    found = told.drop("actor", "cites").join(actors(told, messages, people), "raw_id").join(kept, "raw_id").join(projects.select("thread_id", "project"), "thread_id", "left")
    found = found.withColumn("actor", F.col("person")).withColumn("confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))
    return sole_actor(found, F.lit(owner)).select("raw_id", "thread_id", "actor", "type", F.trim("summary").alias("summary"), "project", "cites", "confidence")
