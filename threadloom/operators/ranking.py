"""Orders, best ones of a group, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group in an order, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)


def main_community(affinity: DataFrame) -> DataFrame:
    """The community of highest affinity of each thread, ties to the smaller one (thread_id, community, affinity)."""
    return best(affinity, ["thread_id"], [F.desc("affinity"), F.col("community")]).drop("rank")


def with_primary(assigned: DataFrame) -> DataFrame:
    """Assignments with ``is_primary``: the project of highest affinity of each thread."""
    first = Window.partitionBy("thread_id").orderBy(F.desc("affinity"), "community")
    return assigned.withColumn("is_primary", F.row_number().over(first) == 1)


def who_to_ask(members: DataFrame, most: int = 4) -> DataFrame:
    """Members of a project by edge weight, involvement and id (project, person, weight, involvement)."""
    return best(members, ["project"], [F.desc("weight"), F.desc("involvement"), F.col("person")], most)


def asked_with_headers(members: DataFrame, cites: DataFrame, most: int = 3, headers: int = 3) -> DataFrame:
    """The members most involved in a project, each with the first cited headers by id (project, person, header)."""
    few = best(cites.select("project", "person", "header").distinct(), ["project", "person"], [F.col("header")], headers)
    listed = few.groupBy("project", "person").agg(F.sort_array(F.collect_list("header")).alias("headers"))
    top = best(members, ["project"], [F.desc("involvement"), F.col("person")], most)
    return top.join(listed, ["project", "person"], "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<bigint>")))


def recent(rows: DataFrame, keys: list[str], ts: str, key: str, most: int) -> DataFrame:
    """The latest rows of each group, ties to smaller ids."""
    return best(rows, keys, [F.desc(ts), F.col(key)], most)


def default_project(projects: DataFrame) -> DataFrame:
    """The project of highest confidence of each mailbox, then by label and id."""
    return best(projects, ["mailbox"], [F.desc("confidence"), F.col("label"), F.col("project_id")]).drop("rank")


def capped_graph(nodes: DataFrame, edges: DataFrame, types: list[str], most_nodes: int = 300, most_edges: int = 800) -> tuple[DataFrame, DataFrame]:
    """Nodes in the order of type, label, id and edges by weight, up to the caps of a report; edges need both ends."""
    turn = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type")), F.lit(len(types) + 1))
    kept = nodes.orderBy(turn, "label", "id").limit(most_nodes)
    ends = kept.select("id")
    inside = edges.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").join(ends.withColumnRenamed("id", "b"), "b", "left_semi")
    return kept, inside.orderBy(F.desc("weight"), "a", "b").limit(most_edges)


def first_citations(cites: DataFrame, keys: list[str], header: str, most: int = 25) -> DataFrame:
    """The first distinct headers of each group in sorted order, as an array, and how many there are.

    Headers are ranked before they are collected, so an array never holds more than ``most``.
    """
    distinct = cites.select(*keys, header).distinct()
    few = best(distinct, keys, [F.col(header)], most).groupBy(*keys).agg(F.sort_array(F.collect_list(header)).alias("citations"))
    return few.join(distinct.groupBy(*keys).agg(F.count("*").alias("total")), keys)


def seeded(seed: int, *columns: str) -> Column:
    """A sort key that is random but the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def sample(rows: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows without replacement, by seeded hash of their ids."""
    return rows.orderBy(seeded(seed, *ids), *ids).limit(n)


def stratified(rows: DataFrame, stratum: str, n: int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows of each stratum without replacement, by seeded hash of stratum and ids."""
    return best(rows, [stratum], [seeded(seed, stratum, *ids), *map(F.col, ids)], n).drop("rank")


def in_thread_order(messages: DataFrame) -> DataFrame:
    """Messages with their place in the thread (by time, then id) from 1."""
    order = Window.partitionBy("thread_id").orderBy("ts", "message_id")
    return messages.withColumn("place", F.row_number().over(order))


def page(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows and on each whether there were more: one row more is asked for."""
    found = rows.orderBy(*order).limit(most + 1).withColumn("turn", F.row_number().over(Window.orderBy(*order)))
    more = found.agg((F.count("*") > most).alias("more"))
    return found.where(F.col("turn") <= most).join(F.broadcast(more), how="cross")


def candidate_labels(labels: DataFrame, fallback: str, other: str) -> DataFrame:
    """Labels with their place: named ones A to Z, then the fallback, then the rest bucket."""
    kind = F.when(F.col("label") == other, 2).when(F.col("label") == fallback, 1).otherwise(0)
    order = Window.orderBy(kind, F.lower("label"), "label")
    return labels.select("label").distinct().withColumn("place", F.row_number().over(order))


def finding_order(findings: DataFrame) -> DataFrame:
    """Findings with their place in the package: high before medium before low, then category and id."""
    severity = F.coalesce(F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("severity")), F.lit(4))
    order = Window.partitionBy("package_id").orderBy(F.when(severity == 0, 4).otherwise(severity), "category", "finding_id")
    return findings.withColumn("place", F.row_number().over(order))


def routes(questions: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """Project or person whose longest label or name stands in the question; ties go to the project.

    Labels and names are single words here, so they meet the questions by equal words.
    """
    words = questions.select("question_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    longest = lambda found, key: found.groupBy("question_id").agg(F.max(F.struct(F.length("word").alias("size"), "word")).alias(key))
    project = longest(words.join(labels.select(F.lower("label").alias("word")).distinct(), "word"), "project")
    person = longest(words.join(names.select(F.lower("name").alias("word")).distinct(), "word"), "person")
    both = project.join(person, "question_id", "full")
    is_project = F.coalesce(F.col("project.size"), F.lit(0)) >= F.coalesce(F.col("person.size"), F.lit(0))
    return both.select("question_id", F.when(is_project, "project").otherwise("person").alias("route"), F.when(is_project, F.col("project.word")).otherwise(F.col("person.word")).alias("target"))
