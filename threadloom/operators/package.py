"""Handoff packages: claims, grounding, coverage, safety findings, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def grounded(claims: DataFrame, allowed: DataFrame, drop_partial: bool = False) -> DataFrame:
    """Claims (claim_id, cites) with citations trimmed to ``allowed`` (cite); none left: claim dropped.

    ``drop_partial`` drops claims with any citation outside instead.
    """
    cited = claims.select("claim_id", F.explode("cites").alias("cite")).distinct()
    good = cited.join(allowed.select("cite").distinct(), "cite", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("cite")).alias("kept"))
    out = claims.join(good, "claim_id")
    if drop_partial:
        out = out.where(F.size("kept") == F.size(F.array_distinct("cites")))
    return out.drop("cites").withColumnRenamed("kept", "cites")


def ask(claims: DataFrame, questions: DataFrame, k: int = 6) -> DataFrame:
    """Claims (package_id, claim_id, text) by shared terms with each question (package_id, question_id, text)."""
    q = questions.select("package_id", "question_id", F.explode(S.tokens(F.col("text"))).alias("term"))
    c = claims.select("package_id", "claim_id", F.explode(S.tokens(F.col("text"))).alias("term"))
    score = q.join(c, ["package_id", "term"]).groupBy("package_id", "question_id", "claim_id").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("package_id", "question_id").orderBy(F.desc("overlap"), "claim_id")
    return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def safety_scan(texts: DataFrame) -> DataFrame:
    """Findings (ref, category, severity, finding_id) of texts (ref, text), one per category and ref.

    Rows are claims, with kind and confidence if the table has these columns; a table with
    ``sender_domain`` holds cited messages instead.  Of a category the severest finding stays.
    """
    has = lambda c, kind: F.col(c) if c in texts.columns else F.lit(None).cast(kind)
    text = F.coalesce("text", F.lit(""))
    if "sender_domain" in texts.columns:
        more = [S.domain_finding(F.col("sender_domain"))]
    else:
        more = S.claim_findings(has("kind", "string"), text, has("confidence", "double"))
    found = texts.select("ref", F.explode(S.findings(text, *more)).alias("x")).groupBy("ref", "x.category").agg(F.min_by("x.severity", F.when(F.col("x.severity") == "high", 0).when(F.col("x.severity") == "medium", 1).otherwise(2)).alias("severity"))
    key = F.sha1(F.concat_ws("|", "category", F.col("ref").cast("string")))
    return found.select("ref", "category", "severity", F.substring(key, 1, 12).alias("finding_id"))


def coverage(claims: DataFrame) -> DataFrame:
    """Per label of claims (label, kind, cites): counts by kind and distinct cited evidence."""
    kinds = claims.groupBy("label").agg(F.count_if(F.col("kind") == "outcome").alias("decisions"), F.count_if(F.col("kind") == "proposed").alias("open_loops"), F.count_if(F.col("kind") == "did").alias("actions"))
    cites = claims.select("label", F.explode("cites").alias("cite")).groupBy("label").agg(F.count_distinct("cite").alias("evidence"))
    return kinds.join(cites, "label", "left").fillna(0, ["evidence"])


def latest_versions(packages: DataFrame) -> DataFrame:
    """Lifecycle: the newest published version of a lineage stays, older ones are superseded."""
    newest = F.max(F.when(F.col("status") == "published", F.col("version"))).over(Window.partitionBy("lineage"))
    old = (F.col("status") == "published") & (F.col("version") < newest)
    return packages.withColumn("status", F.when(old, "superseded").otherwise(F.col("status")))
