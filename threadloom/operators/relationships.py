"""The relationship map: exchanges, organisations, projects, and edges as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import bridges, copresence


def direct_exchange(messages: DataFrame, safe: DataFrame) -> DataFrame:
    """Edges (a, b, evidence, first, last) between senders and recipients over safe headers alone.

    ``messages`` has message_id, sender, recipient, ts; one header counts once for a pair.
    """
    rows = messages.join(safe.select("message_id").distinct(), "message_id", "left_semi").where("sender <> recipient")
    pair = rows.select(F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b"), "message_id", "ts")
    return pair.groupBy("a", "b").agg(F.count_distinct("message_id").alias("evidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def owner_exchange(messages: DataFrame, owner: Column) -> DataFrame:
    """Per counterpart of the owner: headers between the two alone, first and last of them."""
    sides = messages.where((F.col("sender") == owner) != (F.col("recipient") == owner))
    other = F.when(F.col("sender") == owner, F.col("recipient")).otherwise(F.col("sender"))
    return sides.groupBy(other.alias("person")).agg(F.count_distinct("message_id").alias("headers"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def relevant_people(edges: DataFrame, members: DataFrame) -> DataFrame:
    """People with an edge or in a project, once each."""
    return edges.select(F.col("a").alias("person")).union(edges.select("b")).union(members.select("person")).where("person is not null").distinct()


def affiliations(people: DataFrame, public: list[str] = ()) -> DataFrame:
    """Edges from people to the node of their domain, public mail domains aside (person, domain)."""
    rows = people.where(F.col("domain").isNotNull() & (F.col("domain") != "") & ~F.col("domain").isin(list(public)))
    return rows.select("person", F.concat(F.lit("org:"), F.lower("domain")).alias("node")).distinct()


def org_groups(people: DataFrame, own: str, least: int = 2, collapse: int = 5) -> DataFrame:
    """Domains of at least ``least`` people; those of others with ``collapse`` or more start folded."""
    sized = people.groupBy(F.lower("domain").alias("domain")).agg(F.count_distinct("person").alias("members")).where(F.col("members") >= least)
    return sized.withColumn("folded", (F.col("members") >= collapse) & (F.col("domain") != own))


def co_members(members: DataFrame) -> DataFrame:
    """Pairs of people with the number of projects they share (project, person)."""
    return copresence(members.select(F.col("project").alias("group_id"), F.col("person").alias("member"))).withColumnRenamed("shared", "projects")


def project_star(members: DataFrame) -> DataFrame:
    """Edges from each project to its people, weighted by involvement."""
    return members.select(F.concat(F.lit("project:"), "project").alias("a"), F.concat(F.lit("person:"), F.col("person").cast("string")).alias("b"), F.round("involvement", 6).alias("weight"))


def edge_union(**kinds: DataFrame) -> DataFrame:
    """Edges of all kinds (a, b, weight) as (type, a, b, weight)."""
    out = None
    for kind, edges in kinds.items():
        rows = edges.select(F.lit(kind).alias("type"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bridge_edges(members: DataFrame) -> DataFrame:
    """People of two projects or more with the number of them."""
    return bridges(members.select("project", F.col("person").alias("member")))


def filtered_edges(edges: DataFrame, threads: DataFrame, least_evidence: int = 1, least_weight: float = 0.0, days: int | None = None) -> DataFrame:
    """Edges with enough evidence and weight, seen within ``days`` of the latest thread; unknown dates pass."""
    kept = edges.where((F.col("evidence") >= least_evidence) & (F.col("weight") >= least_weight))
    if days is None:
        return kept
    now = threads.agg(F.max("t_end").alias("now"))
    recent = F.col("last_seen").isNull() | (F.col("last_seen") >= F.col("now") - F.make_interval(days=F.lit(days)))
    return kept.join(F.broadcast(now), how="cross").where(recent).drop("now")


def without_orphans(nodes: DataFrame, edges: DataFrame, root: Column) -> DataFrame:
    """Nodes that an edge touches, and the root (id)."""
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("used", F.lit(True))
    return nodes.join(ends, "id", "left").where(F.col("used") | (F.col("id") == root)).drop("used")


def shown_edges(edges: DataFrame, now: Column, weak: float = 0.2, stale_days: int = 180) -> DataFrame:
    """Edges with an id, whether they are muted (weak or stale) and why they are there."""
    stale = F.date_diff(now, "last_seen") > stale_days
    key = F.substring(F.sha2(F.concat_ws("|", "type", F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 16)
    why = F.concat(F.col("evidence").cast("string"), F.when(F.col("evidence") == 1, F.lit(" message")).otherwise(F.lit(" messages")))
    return edges.select("*", key.alias("edge_id"), ((F.col("weight") < weak) | F.coalesce(stale, F.lit(False))).alias("muted"), why.alias("explanation"))


def of_types(edges: DataFrame, types: list[str], known: tuple[str, ...] = ("direct", "copresence", "org", "bridge", "project")) -> DataFrame:
    """Edges of the asked types; an unknown type is an error."""
    if wrong := set(types) - set(known):
        raise ValueError(f"unknown relationship types {sorted(wrong)}")
    return edges.where(F.col("type").isin(types))


def role_edges(edges: DataFrame, people: DataFrame, roles: list[str] | None = None, least_weight: float = 0.0, owner: Column | None = None) -> DataFrame:
    """The network map: edges with their people, of some roles and from some weight on, the owner left out."""
    rows = edges.where(F.col("weight") >= least_weight).join(people, "person")
    rows = rows if roles is None else rows.where(F.col("role").isin(roles))
    return rows if owner is None else rows.where(F.col("person") != owner)
