"""Terms of labels in a number of partitions that goes by the rows."""

from pyspark.sql import functions as F
from threadloom.operators import textfeatures
from threadloom.plans import texts  # noqa: F401
from threadloom.plans.registry import queries


def test_labels_add_up_terms_in_given_partitions(spark):
    bags = spark.range(0, 900).select((F.col("id") % 9).alias("project"), F.concat(F.lit("Term "), F.col("id") * 7 % 23).alias("term"), F.lit(1).cast("long").alias("tf"))
    projects = spark.range(0, 10).select(F.col("id").alias("project"), F.lit("Ann").alias("top"), F.lit("2001-02-03").cast("date").alias("start"))
    summed = bags.groupBy("project", "term").agg(F.sum("tf").alias("tf"))
    found = textfeatures.project_labels(bags, projects, parts=5)
    assert "hashpartitioning(project" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 5)" in plan
    assert sorted(found.collect()) == sorted(textfeatures.project_labels(summed, projects).collect())


def test_query_sums_terms_after_the_shuffle_by_project(spark):
    """The sums of all the terms of a joined partition were held before the shuffle."""
    plan = queries()["WIN_08_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
