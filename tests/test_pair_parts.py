"""Partitions of the pairs of small groups: as many as the pairs ask for."""

from pyspark.sql import functions as F
from threadloom.operators import groups, relations


def test_partitions_grow_with_the_pairs(spark, monkeypatch):
    """AQE joined the partitions by the size of the rows, so that one task held the pairs of many."""
    monkeypatch.setattr(groups, "PART_PAIRS", 500)
    rows = spark.range(0, 12_000).select((F.col("id") % 1_000).alias("group_id"), (F.col("id") * 7 % 3_001).alias("member"))
    found = relations.copresence(rows)
    own = rows.distinct().groupBy("group_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert found.rdd.getNumPartitions() == -(-int(own) // 500)
    a, b = rows.distinct().alias("a"), rows.distinct().alias("b")
    want = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.member") < F.col("b.member"))).groupBy(F.col("a.member").alias("a"), F.col("b.member").alias("b")).agg(F.count("*").alias("shared"))
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_pairs_of_members_in_few_groups_are_not_shuffled(spark):
    rows = spark.range(0, 6_000).select((F.col("id") % 100).alias("group_id"), (F.col("id") * 7 % 2_003).alias("member")).distinct()
    found = groups.pair_sums(rows, chunk=32, dense=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "keys=[a#" not in plan and "array_intersect" in plan and plan.count("array_intersect") == 1
    a, b = rows.alias("a"), rows.alias("b")
    want = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.member") < F.col("b.member"))).groupBy(F.col("a.member").alias("a"), F.col("b.member").alias("b")).agg(F.count("*").alias("total"))
    assert want.where("total > 1").count() > 100
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
