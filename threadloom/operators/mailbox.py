"""Messages, threads, people and the owner's relationship edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .components import connected_components


def owner_edges(contacts: DataFrame, now: Column | None = None) -> DataFrame:
    """Edges from (person, sent boolean, ts, noise boolean): counts, first and last contact, weight.

    Noise counts for nothing.  ``now`` defaults to the latest ts of the table, one row that is
    broadcast.  Rows without a person are left out.
    """
    rows = contacts.where(~F.coalesce("noise", F.lit(False)) & F.col("person").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    edges = rows.groupBy("person").agg(
        F.count("*").alias("message_count"),
        F.count_if("sent").alias("sent_to_count"),
        F.count_if(~F.col("sent")).alias("received_count"),
        F.min("ts").alias("first_contact"),
        F.max("ts").alias("last_contact"),
    )
    if now is None:
        edges, now = edges.join(F.broadcast(rows.agg(F.max("ts").alias("now"))), how="cross"), F.col("now")
    days = F.floor((F.unix_seconds(now) - F.unix_seconds("last_contact")) / 86_400)
    return edges.withColumn("weight", S.edge_weight(F.col("sent_to_count"), F.col("received_count"), days)).drop("now")


def rebuild_threads(messages: DataFrame) -> DataFrame:
    """Thread of each message (message_id, provider_thread_id, refs array): connected components.

    Referenced ids that are not in the table still link; ids that begin with ``synthetic:`` never
    do.  ``lineage_conflict`` marks threads whose provider thread spans several of them.
    """
    real = messages.where(~F.col("message_id").startswith("synthetic:"))
    edges = real.select(F.col("message_id").alias("a"), F.explode("refs").alias("b"))
    found = connected_components(edges)
    out = messages.join(found, messages.message_id == found.node, "left").withColumn("thread", F.coalesce("component", "message_id"))
    spans = out.groupBy("provider_thread_id").agg(F.count_distinct("thread").alias("n")).where("n > 1")
    split = out.join(spans, "provider_thread_id", "left_semi").select("thread").distinct().withColumn("lineage_conflict", F.lit(True))
    return out.select("message_id", "provider_thread_id", "thread").join(split, "thread", "left").fillna(False, ["lineage_conflict"])


def thread_rollup(messages: DataFrame) -> DataFrame:
    """One row per thread of (thread, at, sender, text): first and last, participants, root text."""
    return messages.groupBy("thread").agg(
        F.count("*").alias("n_messages"), F.min("at").alias("t_start"), F.max("at").alias("t_end"), F.min_by("text", "at").alias("root_text"), F.array_sort(F.collect_set("sender")).alias("participants")
    )


def eligible_threads(messages: DataFrame, strict: bool = True) -> DataFrame:
    """Threads of (thread, noise, sensitivity) without a sensitive message; strict: with a clean one."""
    clean = F.col("sensitivity") == F.array(F.lit("none"))
    rolled = messages.groupBy("thread").agg(F.max(clean & ~F.col("noise")).alias("clean"), F.max(~clean).alias("sensitive"))
    return rolled.where(~F.col("sensitive") & (F.col("clean") if strict else F.lit(True))).select("thread")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length; two empty strings are equal."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # a bit that is off: the common subsequence grows at this letter
    for y in b:
        met = row & where.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def name_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else indel_ratio(x.lower(), y.lower()) for x, y in zip(a, b)])


def name_members(people: DataFrame) -> DataFrame:
    """(id, representative): the smallest id of the block with the same name, letter case aside.

    Rows without a block stand for themselves, rows without a name are left out.
    """
    rows = people.where("name is not null").select("id", "block", F.lower("name").alias("name"))
    least = rows.groupBy("block", "name").agg(F.min("id").alias("representative"))
    return rows.join(least, ["block", "name"], "left").select("id", F.coalesce("representative", "id").alias("representative"))


def similar_names(people: DataFrame, least: float = 92.0) -> DataFrame:
    """Pairs of (id, block, name) in one block whose names are similar: the fuzzy identity join.

    Names that differ in letter case alone are one name, of the smallest id; ``name_members`` gives
    the others.  A block is not joined with itself: if d insertions and deletions lead from the
    shorter name to the longer one, one of any d + 1 pieces of the shorter stands whole in the longer,
    at most its insertions or deletions off.  So pieces of one side meet substrings of the other, for each length that
    can reach ``least`` (80 or more).  Empty names are similar to no other.
    """
    if least < 80:
        raise ValueError("names are told apart from a similarity of 80 on")
    share = least / 100
    names = people.where("name <> ''").groupBy("block", F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    names = names.withColumn("n", F.length("name"))
    # edits from a name of n letters to the longest one in reach, and the pieces they leave one of
    edits = lambda n: F.floor((1 - share) * (n + F.floor(n * (2 - share) / share + 1e-9)) + 1e-9).cast("int")
    start = lambda n, i: F.floor(i * n / (edits(n) + 1)).cast("int")
    size = lambda n, i: start(n, i + 1) - start(n, i)
    piece = F.explode(F.sequence(F.lit(0), edits(F.col("n")))).alias("i")
    n, i, at, m = F.col("n"), F.col("i"), F.col("at"), F.col("m")
    short = names.select("*", n.alias("m"), piece).withColumn("piece", F.substring("name", start(n, i) + 1, size(n, i)))
    long_ = names.select("*", F.explode(F.sequence(F.ceil(n * share / (2 - share) - 1e-9).cast("int"), n)).alias("m"))
    long_ = long_.select("*", F.explode(F.sequence(F.lit(0), edits(m))).alias("i"))
    # of d edits that make a name n - m letters longer, (d - n + m) / 2 are deletions
    d = F.floor((1 - share) * (n + m) + 1e-9).cast("int")
    low = F.greatest(F.lit(0), start(m, i) - F.floor((d - n + m) / 2).cast("int"))
    high = F.least(n - size(m, i), start(m, i) + F.floor((d + n - m) / 2).cast("int"))
    long_ = long_.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("at")).withColumn("piece", F.substring("name", at + 1, size(m, i)))
    side = lambda df, c: df.select("block", "m", "i", "piece", F.struct("name", "id").alias(c)).distinct()
    pairs = side(short, "x").join(side(long_, "y"), ["block", "m", "i", "piece"]).where("x.name <> y.name")
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    near = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
    return near.withColumn("similarity", F.round(name_similarity("name_a", "name_b"), 4)).where(F.col("similarity") >= least)


def display_names(mentions: DataFrame) -> DataFrame:
    """(email, names): the distinct names of each address (email, name, at) in the order of their first mention."""
    first = mentions.groupBy("email", F.nullif("name", F.lit("")).alias("name")).agg(F.min("at").alias("at"))
    listed = F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at", "name"))))
    return first.groupBy("email").agg(F.transform(listed, lambda x: x["name"]).alias("names"))


def identities(addresses: DataFrame, least: float = 92.0) -> DataFrame:
    """(id, person) of the addresses (id, block, name): equal and similar names of a block are one person.

    A person is the smallest id of the group.  An address may have several rows, one a name; one
    without a name, or with a name like no other, is a person of its own.
    """
    named = addresses.where("name <> ''")
    same = name_members(named).select(F.col("id").alias("a"), F.col("representative").alias("b"))
    links = same.unionByName(similar_names(named, least).select("a", "b")).where("a <> b")
    found = connected_components(links).withColumnRenamed("node", "id")
    return addresses.select("id").where("id is not null").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("person"))


def persons(addresses: DataFrame, assigned: DataFrame) -> DataFrame:
    """(person, names, identities) with both lists sorted, each entry once."""
    rows = addresses.select("id", F.nullif("name", F.lit("")).alias("name")).join(assigned, "id")
    return rows.groupBy("person").agg(F.sort_array(F.collect_set("name")).alias("names"), F.sort_array(F.collect_set("id")).alias("identities"))


def orgs(addresses: DataFrame, internal: list[str] = ()) -> DataFrame:
    """One row a domain (block), with whether it is one of the ``internal`` ones."""
    domain = F.lower("block").alias("domain")
    return addresses.where("block <> ''").select(domain).distinct().withColumn("internal", F.col("domain").isin([d.lower() for d in internal]))
