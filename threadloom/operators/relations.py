"""Graphs between people, threads and projects; clustering features around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import staged
from .groups import pair_sums


def copresence(members: DataFrame, least: int = 1, chunk: int = 256) -> DataFrame:
    """Pairs of members of one group with the number of groups they share (group_id, member).

    Groups of any size: see ``pair_sums``.
    """
    # staged: the sizes of the groups and the pairs need them
    rows = staged(members.select("group_id", "member").where("group_id is not null and member is not null").distinct(), "members")
    return pair_sums(rows, chunk=chunk).withColumnRenamed("total", "shared").where(F.col("shared") >= least)


def bridges(members: DataFrame, least: int = 2) -> DataFrame:
    """Members of at least ``least`` projects, with the number of them (project, member)."""
    return members.groupBy("member").agg(F.count_distinct("project").alias("projects")).where(F.col("projects") >= least)


def knn_cap(edges: DataFrame, k: int = 15) -> DataFrame:
    """Edges (a, b, w) among the k heaviest of either end; ties go to the smaller other end."""
    both = edges.select("a", "b", "w", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select("a", "b", "w", F.col("b").alias("node"), F.col("a").alias("other")))
    order = Window.partitionBy("node").orderBy(F.desc("w"), "other")
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("a", "b", "w").distinct()


def idf(members: DataFrame) -> DataFrame:
    """ln(N / df) of each member over groups, and whether it is in more than half of them."""
    rows = members.select("group_id", "member").distinct()
    total = rows.agg(F.count_distinct("group_id").alias("n"))
    df = rows.groupBy("member").agg(F.count("*").alias("df")).join(F.broadcast(total), how="cross")
    return df.select("member", "df", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf"), (F.col("df") > 0.5 * F.col("n")).alias("ubiquitous"))


def top_terms(docs: DataFrame, k: int = 12) -> DataFrame:
    """The k terms of each group with the highest tf * ln((1+C)/(1+cdf)) (group_id, text)."""
    terms = docs.select("group_id", F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) >= 3)).alias("term"))
    tf = terms.groupBy("group_id", "term").agg(F.count("*").alias("tf"))
    cdf = tf.groupBy("term").agg(F.count("*").alias("cdf"))
    total = docs.agg(F.count_distinct("group_id").alias("c"))
    scored = tf.join(cdf, "term").join(F.broadcast(total), how="cross").withColumn("score", F.round(F.col("tf") * F.ln((1 + F.col("c")) / (1 + F.col("cdf"))), 6))
    order = Window.partitionBy("group_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("group_id", "rank", "term", "tf", "score")


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each community (community, v) and its size."""
    long = vectors.select("community", F.posexplode("v").alias("i", "x"))
    mean = long.groupBy("community", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = mean.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return packed.join(vectors.groupBy("community").agg(F.count("*").alias("n_members")), "community")


def soft_membership(vectors: DataFrame, profiles: DataFrame, ratio: float = 0.65, least: float = 0.35, at_once: int = 2_000) -> DataFrame:
    """Communities of each vector (id, v): the best one, and others near it.

    ``profiles`` (community, centroid) go to the vectors in blocks of about ``at_once``; of each block
    the best and those of affinity ``least`` or more stay.
    """
    blocks = max(1, -(-profiles.count() // at_once))
    sized = vectors.select("id", "v", F.sqrt(S.dot(F.col("v"), F.col("v"))).alias("size"))
    asked = profiles.select("community", "centroid", F.sqrt(S.dot(F.col("centroid"), F.col("centroid"))).alias("length"))
    order = Window.partitionBy("id").orderBy(F.desc("affinity"), "community")
    scored = None
    for block in range(blocks):
        few = asked.where(F.pmod(F.xxhash64("community"), F.lit(blocks)) == block)  # about at_once rows
        met = sized.join(F.broadcast(few), how="cross").select("id", "community", (S.dot(F.col("v"), F.col("centroid")) / (F.col("size") * F.col("length"))).alias("affinity"))
        met = met.withColumn("rank", F.row_number().over(order)).where((F.col("rank") == 1) | (F.col("affinity") >= least)).drop("rank") if blocks > 1 else met
        scored = met if scored is None else scored.unionByName(met)
    top = F.max("affinity").over(Window.partitionBy("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("top", top)
    kept = ranked.where((F.col("rank") == 1) | ((F.col("affinity") >= least) & (F.col("affinity") >= ratio * F.col("top"))))
    return kept.select("id", "community", F.round(F.greatest("affinity", F.lit(1e-3)), 4).alias("weight"), (F.col("rank") == 1).alias("is_primary"))


def bcubed(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """BCubed precision, recall and F1 of two clusterings (item, label), one label per item.

    Counts of label pairs are enough: no pairs of items are formed.
    """
    both = pred.select("item", F.col("label").alias("p")).join(gold.select("item", F.col("label").alias("g")), "item")
    cell = both.groupBy("p", "g").agg(F.count("*").alias("n"))
    by_p, by_g = cell.groupBy("p").agg(F.sum("n").alias("np")), cell.groupBy("g").agg(F.sum("n").alias("ng"))
    sums = cell.join(by_p, "p").join(by_g, "g").agg(
        (F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / F.sum("n")).alias("recall")
    )
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return sums.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def set_similarity(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """Jaccard and overlap of the sets (id, terms) with each asked set (item_id, terms) that shares a term.

    An inverted index: terms that no asked set holds are dropped first, and shared terms are counted
    before anything else is joined.
    """
    wanted = asked.select("item_id", F.size("terms").alias("m"), F.explode("terms").alias("term"))
    rows = sets.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    shared = rows.join(wanted, "term").groupBy("id", "item_id", "n", "m").agg(F.count("*").cast("int").alias("shared"))
    both = F.col("shared")
    return shared.select("id", "item_id", "shared", F.round(both / (F.col("n") + F.col("m") - both), 6).alias("jaccard"), F.round(both / F.least("n", "m"), 6).alias("overlap"))
