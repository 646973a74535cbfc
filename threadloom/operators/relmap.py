"""The relationship map in its modes: around the owner, of a project, by organisation, as a graph."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import split_groups

#: Kinds of relationships, projects of a bridge, weight below which and days after which an edge is muted
TYPES = ("direct_exchange", "thread_copresence", "project_copresence", "org_affiliation", "bridge")
BRIDGE, WEAK, STALE_DAYS = 2, 0.2, 180
MODES = ("owner", "project", "org", "graph")


def _node(kind: str, c: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _edges(rows: DataFrame, kind: str, a: Column, b: Column, weight: Column, evidence: Column) -> DataFrame:
    seen = lambda c: (F.col(c) if c in rows.columns else F.lit(None)).cast("timestamp").alias(c)
    return rows.select(F.lit(kind).alias("type"), a.alias("a"), b.alias("b"), F.round(weight.cast("double"), 4).alias("weight"), evidence.cast("long").alias("evidence"), seen("first_seen"), seen("last_seen"))


def together(members: DataFrame, kind: str, chunk: int = 256) -> DataFrame:
    """Edges between the people of the same groups (grp, person, start, end): how many they share, from when to when.

    Groups of more than ``chunk`` people are dealt into chunks, every two of which meet apart.
    """
    rows = members.where("grp is not null and person is not null").groupBy("grp", "person").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    sized = rows.join(rows.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    dealt = split_groups(sized, "grp", "person", "n", chunk)
    a, b = dealt.alias("a"), dealt.alias("b")
    same = (F.col("a.grp") == F.col("b.grp")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    once = (F.col("a.lo") == F.col("a.hi")) | (F.col("a.mine") != F.col("b.mine"))
    pairs = a.join(b, same & once & (F.col("a.person") < F.col("b.person")))
    counted = pairs.groupBy(F.col("a.person").alias("x"), F.col("b.person").alias("y")).agg(F.count("*").alias("n"), F.min(F.least("a.start", "b.start")).alias("first_seen"), F.max(F.greatest("a.end", "b.end")).alias("last_seen"))
    return _edges(counted, kind, _node("person", "x"), _node("person", "y"), F.col("n"), F.col("n"))


def affiliated(people: DataFrame, domain_first: bool = False) -> DataFrame:
    """Edges between people (person, domain) and the node of their domain; blank domains have none."""
    rows = people.where("domain <> ''").select("person", F.lower("domain").alias("domain")).distinct()
    ends = (_node("person", "person"), _node("org", "domain"))
    return _edges(rows, "org_affiliation", *(ends[::-1] if domain_first else ends), F.lit(1.0), F.lit(1))


def bridging(members: DataFrame, projects: DataFrame, least: int = BRIDGE) -> DataFrame:
    """Edges from people of ``least`` projects or more to each of them, weighted by their number."""
    own = members.select("project", "person").distinct()
    many = own.groupBy("person").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = own.join(many, "person").join(projects.select("project", F.col("start").alias("first_seen"), F.col("end").alias("last_seen")), "project")
    return _edges(rows, "bridge", _node("person", "person"), _node("project", "project"), F.col("n"), F.col("n"))


def default_project(projects: DataFrame) -> DataFrame:
    """The project of highest confidence, of equals by label and id; one row (project), none without projects."""
    return projects.orderBy(F.desc("confidence"), "label", "project").limit(1).select("project")


def relationship_map(mode: str, direct: DataFrame, threads: DataFrame, members: DataFrame, projects: DataFrame, people: DataFrame, project: DataFrame | None = None, types: list[str] | None = None, least_evidence: int = 1, least_weight: float = 0.0, now: datetime | None = None, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (type, a, b, weight, evidence, first_seen, last_seen, muted) and nodes (id, node_type) of a mode.

    ``direct`` are the owner's safe exchanges (person, headers, first_seen, last_seen), ``threads``
    thread, person, start and end of the threads that may be shown, ``members`` project, person and
    involvement, ``projects`` project, label, confidence, start and end, ``people`` person and domain.
    ``owner`` shows the direct edges and what connects these contacts; ``project`` one project (given
    as a row, else the default) with its members, what connects them and their organisations; ``org``
    the organisations of all people with a relationship; ``graph`` everything with bridges.  Edges
    need evidence and weight and, with ``days``, to be seen so long before ``now`` at most (unknown
    dates pass); nodes that lose all edges go, but for the root.  Unknown modes and types are refused.
    """
    if mode not in MODES or set(types or ()) - set(TYPES):
        raise ValueError(f"unknown mode or types: {mode}, {types}")
    mine = _edges(direct.where("headers > 0"), "direct_exchange", F.lit("owner"), _node("person", "person"), F.col("headers"), F.col("headers"))
    dated = members.join(projects.select("project", "start", "end"), "project")
    by_thread = lambda own: together(threads.join(own, "person", "left_semi").withColumnRenamed("thread", "grp"), "thread_copresence")
    by_project = lambda own: together(dated.join(own, "person", "left_semi").select(F.col("project").alias("grp"), "person", "start", "end"), "project_copresence")
    contacts = direct.where("headers > 0").select("person").distinct()
    relevant = contacts.union(members.select("person")).union(threads.select("person")).where("person is not null").distinct()
    root = None
    if mode == "owner":
        edges, root = mine.unionByName(by_thread(contacts)).unionByName(by_project(contacts)), F.lit("owner")
    elif mode == "project":
        chosen = default_project(projects) if project is None else project.select("project")
        own = members.join(F.broadcast(chosen), "project", "left_semi")  # one row
        who = own.select("person").distinct()
        star = own.groupBy("project", "person").agg(F.max("involvement").alias("w")).join(projects.select("project", F.col("start").alias("first_seen"), F.col("end").alias("last_seen")), "project")
        star = _edges(star, "project_copresence", _node("project", "project"), _node("person", "person"), F.coalesce("w", F.lit(1.0)), F.lit(1))
        edges = star.unionByName(by_thread(who)).unionByName(by_project(who)).unionByName(affiliated(people.join(who, "person", "left_semi")))
    elif mode == "org":
        edges = affiliated(people.join(relevant, "person", "left_semi"), domain_first=True)
    else:
        edges = mine.unionByName(by_thread(relevant)).unionByName(by_project(relevant)).unionByName(affiliated(people.join(relevant, "person", "left_semi"))).unionByName(bridging(members, projects))
    kept = edges.where((F.col("evidence") >= least_evidence) & (F.col("weight") >= least_weight))
    kept = kept if types is None else kept.where(F.col("type").isin(types))
    old = F.lit(False)
    if now is not None:
        old = F.coalesce(F.unix_micros("last_seen") / 1e6 < now.timestamp() - STALE_DAYS * 86_400, F.lit(False))
        if days is not None:
            kept = kept.where(F.col("last_seen").isNull() | (F.unix_micros("last_seen") / 1e6 >= now.timestamp() - days * 86_400))
    kept = kept.withColumn("muted", (F.col("weight") < WEAK) | old)
    ids = kept.select(F.explode(F.array("a", "b")).alias("id"))
    if root is not None:
        ids = ids.unionByName(kept.sparkSession.range(1).select(root.alias("id")))
    elif mode == "project":
        ids = ids.unionByName(chosen.select(_node("project", "project").alias("id")))
    kind = F.substring_index("id", ":", 1)
    nodes = ids.distinct().select("id", F.when(kind == "org", "organization").otherwise(kind).alias("node_type"))
    return kept, nodes


def org_members(edges: DataFrame) -> DataFrame:
    """Groups of the organisation mode: (id, members), people in order (from its edges)."""
    return edges.where("type = 'org_affiliation'").groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("members"))
