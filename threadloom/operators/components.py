"""Connected components by repeated contraction of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Returns ``(node, component)``, one row per node that has an edge.  Edges with a null end are
    ignored, loops give a component of one, repeated edges count once, no edges give no rows.
    Each round hooks every node onto its smallest neighbour, jumps once, and contracts the edge
    list, which at least halves the nodes that still have edges.  Only a flag reaches the driver.
    """
    ends = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"), "links")
    labels = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    rest = staged(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = staged(labels, "labels")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hook = staged(hook.join(up, "p").select("u", F.col("q").alias("p")), "hook")
        labels = staged(
            labels.join(hook.withColumnRenamed("u", "component"), "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")
            ),
            "labels",
        )
        rest = rest.join(hook, "u").select(F.col("p").alias("u"), "v").join(
            hook.select(F.col("u").alias("v"), F.col("p").alias("q")), "v"
        )
        rest = staged(
            rest.where("u <> q").select(F.least("u", "q").alias("u"), F.greatest("u", "q").alias("v")).distinct(), "edges"
        )
    return labels
