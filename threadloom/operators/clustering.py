"""Thread features, similarity of threads, and what follows from a clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, staged
from .groups import LEAST_BLOCKS, pair_sums
from .relations import copresence, idf, knn_cap

#: Weights of participants, embedding, keywords, time, attachments or links.  Fixed values
WEIGHTS = (0.35, 0.30, 0.20, 0.10, 0.05)


def mean_vectors(vectors: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, vector): the weighted mean vector of each key, scaled to length 1; components are summed in Spark."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    each = vectors.select(key, w.alias("w"), F.posexplode("v").alias("i", "x"))
    sums = each.groupBy(key, "i").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("w")).withColumn("m", F.col("s") / F.col("w"))
    listed = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("mean"))  # as long as a vector
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x))
    return listed.select(key, F.transform("mean", lambda x: F.coalesce(F.try_divide(x, norm), x)).alias("vector"))


def sent_counts(messages: DataFrame, owner: Column) -> DataFrame:
    """(thread_id, sent: sender -> messages, participants without the owner)."""
    counted = messages.groupBy("thread_id", "sender").agg(F.count("*").alias("n"))
    listed = counted.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("sender", "n"))).alias("pairs"))
    return listed.select("thread_id", F.map_from_entries("pairs").alias("sent"), F.filter(F.transform("pairs", lambda p: p["sender"]), lambda s: s != owner).alias("participants"))


def project_members(assigned: DataFrame, sent: DataFrame) -> DataFrame:
    """Involvement (affinity x messages) and messages of each person in each project.

    ``assigned`` has thread_id, project and affinity, ``sent`` thread_id, person and n.
    """
    joined = assigned.join(sent, "thread_id")
    return joined.groupBy("project", "person").agg(F.round(F.sum(F.col("affinity") * F.col("n")), 6).alias("involvement"), F.sum("n").alias("message_count"))


def weighted_jaccard(sets: DataFrame, weights: DataFrame, chunk: int = 256) -> DataFrame:
    """Weighted Jaccard similarity of the pairs of ids that share an item (id, item); items without weight weigh 1.

    Items of any number of ids: see ``pair_sums``.
    """
    rows = sets.where("id is not null and item is not null").distinct().join(weights, "item", "left").select("id", "item", F.coalesce("weight", F.lit(1.0)).alias("w"))
    own = rows.groupBy("id").agg(F.sum("w").alias("own"))
    both = pair_sums(rows.select(F.col("item").alias("group_id"), F.col("id").alias("member"), "w"), weighted=True, chunk=chunk).withColumnRenamed("total", "both")
    side = lambda c: own.select(F.col("id").alias(c), F.col("own").alias(f"own_{c}"))
    union = F.col("own_a") + F.col("own_b") - F.col("both")
    return both.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(F.coalesce(F.try_divide(F.col("both"), union), F.lit(0.0)), 6).alias("similarity"))


def weighted_jaccard_classes(sets: DataFrame, weights: DataFrame, chunk: int = 256) -> DataFrame:
    """(kind, a, b, similarity): classes of ids with equal sets (id, item), and the similarity of the classes.

    A ``member`` row names the class of each id: ``a`` is the smallest id with the same set, ``b`` the
    id.  The ``pair`` rows are those of ``weighted_jaccard`` between these smallest ids.  So the
    similarity of any two ids is that of their classes, and copies are not expanded into pairs.
    """
    rows, named = _equal_sets(sets)
    different = rows.join(named.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    member = named.select(F.lit("member").alias("kind"), "a", "b", F.lit(1.0).alias("similarity"))
    return member.unionByName(weighted_jaccard(different, weights, chunk).select(F.lit("pair").alias("kind"), "a", "b", "similarity"))


def _equal_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct rows (id, item) without nulls, and the class ``a`` of each id ``b``: the smallest id with the same set."""
    rows = staged(sets.where("id is not null and item is not null").select("id", "item").distinct(), "sets")
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    classes = listed.groupBy("items").agg(F.min("id").alias("a"))
    return rows, staged(listed.join(classes, "items").select("a", F.col("id").alias("b")), "classes")


def weighted_jaccard_all(sets: DataFrame, weights: DataFrame, chunk: int = 4_096) -> DataFrame:
    """(kind, a, b, similarity): the ``member`` rows of ``weighted_jaccard_classes``, and a ``pair`` row for every
    two ids that share an item, as ``weighted_jaccard`` gives them.

    Similarities are found once for every two classes.  The ids of a class lie in lists of about
    ``chunk``; every two lists meet in one row, which is expanded where it is, so no pair is shuffled
    or held.
    """
    rows, named = _equal_sets(sets)
    different = rows.join(named.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    own = different.join(weights, "item", "left").groupBy("id").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("own"))
    alike = own.select(F.col("id").alias("a"), F.col("id").alias("b"), F.coalesce(F.try_divide("own", "own"), F.lit(0.0)).alias("similarity"))
    classes = weighted_jaccard(different, weights).unionByName(alike)
    lists = named.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("lists"))
    dealt = named.join(lists, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("lists")).cast("int"))
    dealt = staged(dealt.groupBy(F.col("a").alias("class"), "slot").agg(F.collect_list("b").alias("ids")), "lists")
    places = dealt.select("class", "slot")
    side = lambda df, c: df.select(*(F.col(x).alias(f"{x}_{c}") for x in df.columns))
    met = classes.join(side(places, "x"), F.col("a") == F.col("class_x")).join(side(places, "y"), F.col("b") == F.col("class_y"))
    met = met.where("a <> b or slot_x <= slot_y").select("class_x", "slot_x", "class_y", "slot_y", "similarity")
    met = met.join(side(dealt, "x"), ["class_x", "slot_x"]).join(side(dealt, "y"), ["class_y", "slot_y"])
    n = places.count()
    met = met.repartition(max(LEAST_BLOCKS, n * (n + 1) // 16), "class_x", "slot_x", "class_y", "slot_y")
    same = (F.col("class_x") == F.col("class_y")) & (F.col("slot_x") == F.col("slot_y"))
    pairs = met.select(same.alias("same"), "similarity", "ids_y", F.explode("ids_x").alias("x")).select("same", "similarity", "x", F.explode("ids_y").alias("y"))
    pairs = pairs.where("not same or x < y").select(F.lit("pair").alias("kind"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return named.select(F.lit("member").alias("kind"), "a", "b", F.lit(1.0).alias("similarity")).unionByName(pairs)


def rare_members(members: DataFrame, most_groups: int = 300) -> DataFrame:
    """The rows of ``members`` whose participant is in at most ``most_groups`` groups and not ubiquitous.

    The limit on groups is the rule of the search itself: frequent participants tell threads apart badly.
    """
    rare = idf(members).where((F.col("df") <= most_groups) & ~F.col("ubiquitous")).select("member")
    return members.join(rare, "member", "left_semi").select("group_id", "member")


def rare_pairs(members: DataFrame, most_groups: int = 300, least: int = 1) -> DataFrame:
    """Pairs of groups that share a participant of ``rare_members``."""
    rows = rare_members(members, most_groups)
    return copresence(rows.select(F.col("member").alias("group_id"), F.col("group_id").alias("member")), least)


def thread_similarity(participants: Column, embedding: Column, keywords: Column, time: Column, links: Column) -> Column:
    """Weighted sum of the five similarities; a negative cosine counts as none."""
    parts = (participants, F.greatest(embedding, F.lit(0.0)), keywords, time, links)
    return sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:])), WEIGHTS[0] * parts[0])


def similarity_graph(scored: DataFrame, least: float, k: int = 15) -> DataFrame:
    """Edges (a, b, w) with w >= least, rounded to six places, among the k heaviest of either end."""
    return knn_cap(scored.select("a", "b", F.round("w", 6).alias("w")).where(F.col("w") >= least), k)


def renumbered(assigned: DataFrame) -> DataFrame:
    """Communities numbered from 0 in the order of their smallest members (item, community)."""
    first = assigned.groupBy("community").agg(F.min("item").alias("least"))
    number = first.select("community", (F.row_number().over(Window.orderBy("least")) - 1).alias("number"))  # a row a community
    return assigned.join(number, "community").select("item", F.col("number").alias("community"))


def cohesion(vectors: DataFrame, key: str = "community", most: int = 200, seed: int = 0) -> DataFrame:
    """Mean dot product over the pairs of at most ``most`` members of each community, drawn by seeded hash.

    The mean over pairs follows from the sum of the vectors: (|sum|^2 - sum of |v|^2) / (n (n - 1)).
    """
    from .ranking import stratified

    few = stratified(vectors, key, most, seed, "id")
    parts = few.select(key, "id", F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    sums = parts.groupBy(key, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq")).join(few.groupBy(key).agg(F.count("*").alias("n")), key)
    mean = F.try_divide(F.col("ss") - F.col("qq"), F.col("n") * (F.col("n") - 1))
    return total.select(key, F.round(F.coalesce(mean, F.lit(1.0)), 4).alias("cohesion"))


def separation(centroids: DataFrame, key: str = "community") -> DataFrame:
    """1 - the highest cosine of a centroid with any other; alone, or without length, it is 1.

    Every centroid meets every other, in blocks of bounded size.
    """
    from .neighbours import nearest

    best = nearest(centroids.select(F.col(key).alias("id"), F.col("vector").alias("v")), k=1, cells=1, places=12)
    found = centroids.select(key).join(best.select(F.col("id").alias(key), "similarity"), key, "left")
    return found.select(key, F.round(1 - F.coalesce("similarity", F.lit(0.0)), 4).alias("separation"))


def project_confidence(cohesion: Column, separation: Column, size: Column) -> Column:
    """0.5 cohesion + 0.3 separation + 0.2 size (full from 10 threads on), between 0 and 1, three places."""
    raw = 0.5 * cohesion + 0.3 * separation + 0.2 * F.least(F.lit(1.0), size / 10)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def attached(affinity: DataFrame, least: float = 0.45, most_orphans: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """New threads at their best community if its affinity is ``least``, else orphans; and the share of
    orphans with whether to cluster anew."""
    from .ranking import main_community

    top = main_community(affinity)
    out = top.withColumn("community", F.when(F.col("affinity") >= least, F.col("community")))
    ratio = F.round(F.try_divide(F.count_if(F.col("community").isNull()), F.count("*")), 6)
    return out, out.agg(ratio.alias("orphan_ratio")).withColumn("recluster", F.col("orphan_ratio") > most_orphans)


def member_jaccard(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new, old, jaccard) of the communities that share an item, from (item, community) tables.

    Communities may overlap; repeated rows count once, rows with a null are left out.
    """
    new, old = (rows.select("item", "community").where("item is not null and community is not null").distinct() for rows in (new, old))
    joined = new.select("item", F.col("community").alias("new")).join(old.select("item", F.col("community").alias("old")), "item")
    both = joined.groupBy("new", "old").agg(F.count("*").alias("both"))
    size = lambda df, c: df.groupBy(F.col("community").alias(c)).agg(F.count("*").alias(f"n_{c}"))
    sized = both.join(size(new, "new"), "new").join(size(old, "old"), "old")
    return sized.select("new", "old", (F.col("both") / (F.col("n_new") + F.col("n_old") - F.col("both"))).alias("jaccard"))


def greedy_matching(pairs: DataFrame, first: str, second: str, score: str) -> DataFrame:
    """The pairs that are taken if the ``first`` ones choose in their order, each the best ``second`` one left.

    Of equal scores the smaller ``second`` one is better; one that finds none left stays without.  In
    each round the best choice of every ``first`` one is final if no smaller ``first`` one that is
    still without could take it.  Those that wait lose only what is taken, so the rounds give what
    choosing one after the other gives; at least the smallest of those left is settled in a round.
    """
    left = staged(pairs.select(first, second, score), "pairs")
    taken = []
    while not left.isEmpty():
        best = left.groupBy(first).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(second).alias("o"))).alias("best"))
        claim = left.groupBy(second).agg(F.min(first).alias("claim"))
        fixed = best.select(first, F.col("best.o").alias(second), (-F.col("best.s")).alias(score)).join(claim, second).where(F.col(first) == F.col("claim"))
        fixed = staged(fixed.select(first, second, score), "taken")
        after = left.join(fixed.select(first), first, "left_anti").join(fixed.select(second), second, "left_anti")
        after = staged(after, "pairs")
        discard(left)
        left = after
        taken.append(fixed)
    out = left
    for some in taken:
        out = out.unionByName(some)
    return out


def carried_over(new: DataFrame, old: DataFrame, least: float = 0.5) -> DataFrame:
    """(new, old, jaccard): the old id that each new community goes on with, if any.

    New communities choose in the order of their ids, each the old one of highest Jaccard similarity
    that no earlier one has taken, if that is ``least`` at least.  Communities may overlap, so a
    second choice may be due.
    """
    pairs = member_jaccard(new, old).where(F.col("jaccard") >= least)
    return greedy_matching(pairs, "new", "old", "jaccard").withColumn("jaccard", F.round("jaccard", 6))


def sticky_labels(new: DataFrame, overrides: DataFrame, least: float = 0.5) -> DataFrame:
    """(new, label): the label that users gave the most similar labelled set of threads.

    ``overrides`` are (item, community, label); of equal similarity the smaller community's label
    stands, a set may give its label to several new communities, and below ``least`` there is none.
    """
    pairs = member_jaccard(new, overrides).where(F.col("jaccard") >= least)
    best = pairs.groupBy("new").agg(F.min(F.struct((-F.col("jaccard")).alias("s"), F.col("old").alias("community"))).alias("best"))
    labels = overrides.where("community is not null").groupBy("community").agg(F.min("label").alias("label"))
    return best.select("new", F.col("best.community").alias("community")).join(labels, "community").select("new", "label")
