"""Hits of both searches as evidence: gates, links to projects and people, one score, and the order of a reranker."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Least raw scores, weights of the pools, what known projects and people add, hits that stay
LEAST_VECTOR, LEAST_TEXT, VECTOR, TEXT, PROJECT, PERSON, TOP = 0.60, 0.0, 0.6, 0.4, 0.15, 0.10, 10


def linked(hits: DataFrame, messages: DataFrame, assigned: DataFrame, identities: DataFrame) -> DataFrame:
    """``hits`` (query_id, id) with ts, noise, sensitivity, and the sorted ``projects`` and ``people`` of each message.

    ``messages`` are id, thread, ts, noise, sensitivity (array), sender and recipients (array of
    addresses); ``assigned`` thread and project, ``identities`` email and person.  Hits of messages
    that are not there are left out.
    """
    found = messages.join(hits.select("id").distinct(), "id", "left_semi")
    projects = found.select("id", "thread").join(assigned.select("thread", "project").distinct(), "thread").groupBy("id").agg(F.array_sort(F.collect_set("project")).alias("projects"))
    known = identities.where("email is not null and person is not null").select(F.col("email").alias("address"), "person").distinct()
    addresses = F.array_compact(F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>"))))
    people = found.select("id", F.explode(addresses).alias("address")).join(known, "address").groupBy("id").agg(F.array_sort(F.collect_set("person")).alias("people"))
    told = found.select("id", "ts", "noise", "sensitivity").join(projects, "id", "left").join(people, "id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    told = told.select("id", "ts", "noise", "sensitivity", none("projects", projects.schema["projects"].dataType), none("people", people.schema["people"].dataType))
    return hits.join(told, "id")


def readable_hits(hits: DataFrame, noise: bool = False, sensitive: bool = False) -> DataFrame:
    """Hits without noise and sensitive messages, unless they are asked for."""
    out = hits if noise else hits.where(~F.coalesce("noise", F.lit(False)))
    return out if sensitive else out.where(F.size(F.coalesce("sensitivity", F.array(F.lit("none")))) == F.size(F.filter(F.coalesce("sensitivity", F.array(F.lit("none"))), lambda s: s == "none")))


def evidence(vector_hits: DataFrame, text_hits: DataFrame, now: datetime, least_vector: float = LEAST_VECTOR, least_text: float = LEAST_TEXT, most: int = TOP) -> DataFrame:
    """(query_id, id, rank, source, vector_score, text_score, score, projects, people): the best hits of both searches.

    Hits (query_id, id, score, ts, projects, people) pass their gate, are scaled inside their pool from
    0 to 1 (1 if all are equal), weighed, and gain from known projects, known people and recency.
    Ties go to smaller ids.  A query of which no hit passes has no rows.
    """

    def pool(hits: DataFrame, least: float, name: str) -> DataFrame:
        rows = hits.where(F.col("score") >= least)
        every = Window.partitionBy("query_id")
        low, high = F.min("score").over(every), F.max("score").over(every)
        return rows.select("query_id", "id", F.struct("ts", "projects", "people").alias(f"told_{name}"), F.col("score").alias(f"{name}_score"), F.when(low == high, 1.0).otherwise((F.col("score") - low) / (high - low)).alias(f"{name}_norm"))

    both = pool(vector_hits, least_vector, "vector").join(pool(text_hits, least_text, "text"), ["query_id", "id"], "full_outer").withColumn("told", F.coalesce("told_vector", "told_text"))
    source = F.when(F.col("vector_score").isNull(), "fts").when(F.col("text_score").isNull(), "vector").otherwise("hybrid")
    age = (F.lit(now.timestamp()) - F.unix_micros(F.col("told.ts").cast("timestamp")) / 1e6) / 86_400
    gain = F.when(F.size("told.projects") > 0, PROJECT).otherwise(0.0) + F.when(F.size("told.people") > 0, PERSON).otherwise(0.0) + F.coalesce(S.recency(age), F.lit(0.0))
    score = VECTOR * F.coalesce("vector_norm", F.lit(0.0)) + TEXT * F.coalesce("text_norm", F.lit(0.0)) + gain
    both = both.withColumn("source", source).withColumn("score", F.round(score, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("query_id", "id", "rank", "source", "vector_score", "text_score", "score", "told.projects", "told.people")


def reranked(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """The candidates (query_id, id, ...) in a reranker's order (query_id, id, score); the rest of a row stays as it was.

    A reranker may leave hits out.  One that returns a hit it was not given, or one twice, is refused.
    """
    own = order.select("query_id", "id", F.col("score").alias("new"))
    if not own.join(candidates, ["query_id", "id"], "left_anti").isEmpty():
        raise ValueError("the reranker returned a hit that it was not given")
    if not own.groupBy("query_id", "id").count().where("count > 1").isEmpty():
        raise ValueError("the reranker returned a hit twice")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return candidates.join(own, ["query_id", "id"]).withColumn("score", F.col("new")).drop("new").withColumn("rank", F.row_number().over(place))
