"""Average linkage over pair tables, for many small groups at once, and the choice of a way to cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, staged
from .communities import leiden

#: Fixed value: groups of fewer threads are clustered by linkage
SMALL = 30


def average_linkage(items: DataFrame, pairs: DataFrame, cut: float, far: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Clusters (grp, item, cluster) of items (grp, item), and the merges (grp, a, b, height, size).

    ``pairs`` (grp, a, b, d) are distances of items of one group, in either order; a pair that is
    missing is ``far`` apart, of repeated ones the least counts.  Clusters whose mean distance is the
    least for both sides merge, as long as it is ``cut`` at most; all such pairs of all groups merge
    in one round, which gives the heights of merging one after the other.  Equal distances go to the
    smaller items.  A cluster has the name of its smallest item.  The table holds the pairs of a group,
    so it grows with the square of its items: meant for groups that are small.
    """
    own = items.select("grp", "item").distinct()
    ends = pairs.where("a <> b").select("grp", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("d").cast("double").alias("d"))
    given = ends.groupBy("grp", "x", "y").agg(F.min("d").alias("d"))
    side = lambda c: own.select("grp", F.col("item").alias(c))
    every = side("x").join(side("y"), "grp").where("x < y").join(given, ["grp", "x", "y"], "left")
    state = staged(every.select("grp", "x", "y", F.coalesce("d", F.lit(far)).alias("s"), F.lit(1).cast("long").alias("n")), "pairs")
    of = staged(own.withColumn("cluster", F.col("item")), "clusters")
    merges = []
    while True:
        # rounded: sums of other orders may differ in the last place
        mean = F.round(F.col("s") / F.col("n"), 12).alias("d")
        both = state.select("grp", "x", "y", mean, F.col("x").alias("c"), F.col("y").alias("o")).unionByName(state.select("grp", "x", "y", mean, F.col("y").alias("c"), F.col("x").alias("o")))
        first = both.where(F.col("d") <= cut).groupBy("grp", "c").agg(F.min(F.struct("d", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"))).alias("m"))
        taken = first.groupBy("grp", "m.x", "m.y", "m.d").agg(F.count("*").alias("k")).where("k = 2").select("grp", "x", "y", "d")
        taken = staged(taken, "taken")
        if taken.isEmpty():
            discard(taken)
            break
        to = staged(taken.select("grp", F.col("y").alias("c"), F.col("x").alias("to")), "to")
        renamed = lambda c: to.select("grp", F.col("c").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        after = of.join(renamed("cluster"), ["grp", "cluster"], "left").select("grp", "item", F.coalesce("to_cluster", "cluster").alias("cluster"))
        after = staged(after, "clusters")
        moved = state.join(renamed("x"), ["grp", "x"], "left").join(renamed("y"), ["grp", "y"], "left").select("grp", F.coalesce("to_x", "x").alias("u"), F.coalesce("to_y", "y").alias("v"), "s", "n").where("u <> v")
        fewer = moved.groupBy("grp", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        fewer = staged(fewer, "pairs")
        sizes = after.groupBy("grp", F.col("cluster").alias("x")).agg(F.count("*").alias("size"))
        merges.append(staged(taken.join(sizes, ["grp", "x"]).select("grp", F.col("x").alias("a"), F.col("y").alias("b"), F.col("d").alias("height"), "size"), "merges"))
        discard(state, of, taken, to)
        state, of = fewer, after
    kind = items.schema["item"].dataType
    done = of.limit(0).select("grp", F.col("item").cast(kind).alias("a"), F.col("item").cast(kind).alias("b"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("size"))
    for some in merges:
        done = done.unionByName(some)
    return of, done


def clustered(threads: DataFrame, scored: DataFrame, graph: DataFrame, least: float = 0.45, small: int = SMALL) -> DataFrame:
    """(mailbox, thread, cluster, strategy): linkage for mailboxes of fewer than ``small`` threads, else communities.

    ``threads`` are (mailbox, thread) with thread ids that no other mailbox has, ``scored`` (mailbox,
    a, b, w) the similarities of all pairs of the small mailboxes, ``graph`` (a, b, w) the similarity
    graph of the others; no thread of one is an end in the graph of the other.
    """
    sized = threads.select("mailbox", "thread").distinct().withColumn("n", F.count("*").over(Window.partitionBy("mailbox")))
    few, many = sized.where(F.col("n") < small), sized.where(F.col("n") >= small)
    near, _ = average_linkage(few.select(F.col("mailbox").alias("grp"), F.col("thread").alias("item")), scored.select(F.col("mailbox").alias("grp"), "a", "b", (1 - F.col("w")).alias("d")), 1 - least)
    near = near.select(F.col("grp").alias("mailbox"), F.col("item").alias("thread"), "cluster", F.lit("agglomerative").alias("strategy"))
    ends = many.select(F.col("thread").alias("a"))
    found = leiden(graph.join(ends, "a", "left_semi"), nodes=many.select(F.col("thread").alias("node")))
    far = many.join(found.select(F.col("node").alias("thread"), F.col("community").alias("cluster")), "thread").select("mailbox", "thread", "cluster", F.lit("leiden").alias("strategy"))
    return near.unionByName(far)
