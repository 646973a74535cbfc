"""Coverage areas of a package: claims linked by citations and shared words, and what each area holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

#: Words that say nothing about a topic
COMMON = (
    "the a an and or but to of in on for with at by from as is are was were be been it its "
    "this that these those we our you your they their next sprint week weekly update updates status items "
    "item remaining review notes note plan plans steps step inputs input fyi re fwd all new now has have had "
    "will into out off per via not no yes"
).split()
#: Least letters of a word; claims that a telling word occurs in at most; words of a long label
LEAST_LETTERS, TELLING, LABEL_CHARS = 3, 2, 60


def cited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(package_id, claim_id, header, subject, place) of the citations that lie in the claim's package.

    ``claims`` have package_id, claim_id and cites (array of headers), ``evidence`` package_id,
    header, subject and place (its order); of a header that repeats the last one stands.
    """
    asked = claims.select("package_id", "claim_id", F.explode("cites").alias("header")).distinct()
    once = evidence.groupBy("package_id", "header").agg(F.max(F.struct("place", "subject")).alias("e"))
    return asked.join(once.select("package_id", "header", "e.subject", "e.place"), ["package_id", "header"])


def claim_words(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(package_id, claim_id, word): the salient words of each claim (text) and of the subjects it cites, once each."""
    texts = claims.select("package_id", "claim_id", "text").unionByName(citations.select("package_id", "claim_id", F.col("subject").alias("text")))
    words = texts.select("package_id", "claim_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z0-9]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("word"))
    return words.where(~F.col("word").isin(COMMON)).distinct()


def claim_links(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(package_id, a, b): links that join the same claims as these: a shared citation, a shared word of
    at most ``TELLING`` claims, or two shared words.

    The claims that share a citation, a telling word or a pair of words are each linked with the
    smallest of them alone, so a word that all claims hold costs a row a claim and not a row a pair of
    claims.  The work grows with the square of the words of one claim.
    """
    citations = cited(claims, evidence)
    words = claim_words(claims, citations)
    counted = words.join(words.groupBy("package_id", "word").agg(F.count("*").alias("df")), ["package_id", "word"]).where("df > 1")
    common = counted.where(F.col("df") > TELLING)
    x, y = common.select("package_id", "claim_id", F.col("word").alias("x")), common.select("package_id", "claim_id", F.col("word").alias("y"))
    pairs = x.join(y, ["package_id", "claim_id"]).where("x < y")
    key = lambda kind, *columns: F.struct(F.lit(kind).alias("kind"), *columns).alias("key")
    none = F.lit("").alias("y")
    shared = citations.select("package_id", "claim_id", key("cite", F.col("header").cast("string").alias("x"), none))
    shared = shared.unionByName(counted.where(F.col("df") <= TELLING).select("package_id", "claim_id", key("word", F.col("word").alias("x"), none)))
    shared = shared.unionByName(pairs.select("package_id", "claim_id", key("pair", "x", "y")))
    first = shared.groupBy("package_id", "key").agg(F.min("claim_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return shared.join(first, ["package_id", "key"]).where("claim_id <> a").select("package_id", "a", F.col("claim_id").alias("b")).distinct()


def claim_areas(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(package_id, claim_id, area): the area of each claim, named after its first claim."""
    links = claim_links(claims, evidence)
    node = lambda c: F.struct("package_id", F.col(c).alias("claim_id"))
    found = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    found = found.select("node.package_id", "node.claim_id", F.col("component.claim_id").alias("area"))
    return claims.select("package_id", "claim_id").distinct().join(found, ["package_id", "claim_id"], "left").withColumn("area", F.coalesce("area", "claim_id"))


def coverage_areas(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Areas of each package: first claim, label, claims, decisions, open loops, people, evidence, and the rank.

    Claims are package_id, claim_id (in their order), text, kind and cites; evidence is package_id,
    header, subject, sender_domain, sender_display and place.  The label is the first cited subject
    that is not blank, else the beginning of the first claim.  Areas with most decisions and open loops
    come first, then those with most claims, then by label and first claim.  Claims without text or
    citations stand alone; packages without claims have no areas.
    """
    of = claim_areas(claims, evidence)
    keys = ["package_id", "area"]
    kinds = claims.join(of, ["package_id", "claim_id"]).groupBy(*keys).agg(
        F.count("*").alias("claims"), F.count_if(F.col("kind") == "decision").alias("decisions"), F.count_if(F.col("kind") == "open_loop").alias("open_loops"), F.min(F.struct("claim_id", "text"))["text"].alias("text")
    )
    cites = cited(claims, evidence).join(of, ["package_id", "claim_id"]).select(*keys, "header", "subject", "place").distinct()
    senders = evidence.groupBy("package_id", "header").agg(F.max(F.struct("place", "sender_domain", "sender_display")).alias("e")).select("package_id", "header", "e.sender_domain", "e.sender_display")
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    person = F.lower(F.coalesce(filled("sender_domain"), filled("sender_display"), F.lit("Unknown sender")))
    subject = filled("subject")
    held = cites.join(senders, ["package_id", "header"]).groupBy(*keys).agg(F.count("*").alias("evidence"), F.count_distinct(person).alias("people"), F.min(F.when(subject.isNotNull(), F.struct("place", subject.alias("subject"))))["subject"].alias("subject"))
    start = F.nullif(F.substring("text", 1, LABEL_CHARS), F.lit(""))
    out = kinds.join(held, keys, "left").withColumn("label", F.coalesce("subject", start, F.lit("Coverage area")))
    place = Window.partitionBy("package_id").orderBy(F.desc(F.col("decisions") + F.col("open_loops")), F.desc("claims"), "label", "area")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*keys, "label", "claims", "decisions", "open_loops", zero("people"), zero("evidence"), F.row_number().over(place).alias("rank"))
