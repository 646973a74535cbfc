"""Packages made from packages: the scope that a return starts from, and forks to a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scope

#: Words of project labels that match nothing
COMMON = "the and for with team project work misc general other into from about notes update updates".split()


def label_words(label: Column) -> Column:
    """The words of a label that can match: of three or more ASCII letters or digits, in lower case, once each."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(label, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda w: ~w.isin(COMMON)))


def _sorted(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def return_scope(returns: DataFrame, scopes: DataFrame, claims: DataFrame, evidence: DataFrame, projects: DataFrame, identities: DataFrame) -> DataFrame:
    """What a return (return_id, package, mailbox: the original package and the coverer's mailbox) starts from.

    ``scopes`` are package, mailbox, projects, people and domains (arrays), ``claims`` package and
    project, ``evidence`` package and sender_domain, ``projects`` mailbox, project and label,
    ``identities`` mailbox, person and email.  The coverer's projects are those whose label shares a
    word with a carried project's; the coverer's people are those with an address of a carried person
    or of a carried domain.  Projects go before people, so only one of the two narrows the scope; the
    method says which of them were found.  Returns the resolved and the carried projects and people,
    the domains and labels (sorted arrays), and ``method``.
    """
    asked = returns.select("return_id", "package", F.col("mailbox").alias("coverer")).join(scopes.select("package", F.col("mailbox").alias("original"), "projects", "people", "domains"), "package", "left")
    key = asked.select("return_id", "package", "coverer", "original")
    carried = asked.select("return_id", F.explode("projects").alias("project")).unionByName(key.join(claims.select("package", "project"), "package").select("return_id", "project")).where("project is not null").distinct()
    people = asked.select("return_id", F.explode("people").alias("person")).where("person is not null").distinct()
    domains = asked.select("return_id", F.explode("domains").alias("domain")).unionByName(key.join(evidence.select("package", F.col("sender_domain").alias("domain")), "package").select("return_id", "domain"))
    domains = domains.select("return_id", F.lower("domain").alias("domain")).where("domain <> ''").distinct()

    own = carried.join(key, "return_id").join(projects.select(F.col("mailbox").alias("original"), "project", "label"), ["original", "project"]).where("label <> ''")
    words = own.select("return_id", "coverer", F.explode(label_words(F.col("label"))).alias("word")).distinct()
    theirs = projects.select(F.col("mailbox").alias("coverer"), "project", F.explode(label_words(F.col("label"))).alias("word"))
    found_projects = words.join(theirs, ["coverer", "word"]).select("return_id", "project").distinct()

    known = identities.select("mailbox", "person", F.lower("email").alias("email")).where("person is not null and email <> ''").distinct()
    emails = people.join(key, "return_id").join(known.withColumnRenamed("mailbox", "original"), ["original", "person"]).select("return_id", "coverer", "email").distinct()
    by_email = emails.join(known.select(F.col("mailbox").alias("coverer"), F.col("person").alias("theirs"), "email"), ["coverer", "email"])
    hosts = known.where(F.contains("email", F.lit("@"))).select(F.col("mailbox").alias("coverer"), F.col("person").alias("theirs"), F.substring_index("email", "@", -1).alias("domain")).distinct()
    by_domain = domains.join(key.select("return_id", "coverer"), "return_id").join(hosts, ["coverer", "domain"])
    found_people = by_email.select("return_id", F.col("theirs").alias("person")).unionByName(by_domain.select("return_id", F.col("theirs").alias("person"))).distinct()

    out = key.select("return_id")
    for rows, value, name in ((found_projects, "project", "found_projects"), (found_people, "person", "found_people"), (carried, "project", "carried_projects"), (people, "person", "carried_people"), (domains, "domain", "domains"), (own, "label", "labels")):
        kind = rows.schema[value].dataType.simpleString()
        out = out.join(_sorted(rows, "return_id", value, name), "return_id", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    some_projects, some_people = F.size("found_projects") > 0, F.size("found_people") > 0
    method = F.when(some_projects, F.when(some_people, "mixed").otherwise("structured")).when(some_people & (F.size("carried_projects") > 0), "mixed").otherwise("snapshot_hints")
    nobody = F.array().cast(out.schema["found_people"].dataType)
    return out.select("return_id", F.col("found_projects").alias("projects"), F.when(some_projects, nobody).otherwise(F.col("found_people")).alias("people"), "carried_projects", "carried_people", "domains", "labels", method.alias("method"))


def forked(packages: DataFrame, scopes: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New drafts (package, lineage, version, status, forked_from, ...) and their scopes, for ``asked`` (package, new).

    A fork has the next version of its lineage - forks of one lineage count on in the order of their
    new ids -, the scope of its source as it is, and none of its claims.  Packages that are not there
    give none.
    """
    last = packages.groupBy("lineage").agg(F.max("version").alias("last"))
    rows = asked.join(packages, "package").join(last, "lineage")
    turn = F.row_number().over(Window.partitionBy("lineage").orderBy("new"))
    made = rows.withColumn("next", F.col("last") + turn)
    kept = [c for c in packages.columns if c not in ("package", "version", "status")]
    drafts = made.select(F.col("new").alias("package"), F.col("next").alias("version"), F.lit("draft").alias("status"), F.col("package").alias("forked_from"), *kept)
    copied = scopes.join(made.select("package", "new"), "package").drop("package").withColumnRenamed("new", "package")
    return drafts, copied.select(*scopes.columns)


def assembled(events: DataFrame, messages: DataFrame, labels: DataFrame, first: str | None = None, last: str | None = None, projects: list[str] | None = None, excluded_threads: DataFrame | None = None, excluded_messages: DataFrame | None = None) -> dict[str, DataFrame]:
    """The candidate of a package: ``claims``, ``evidence``, ``exclusions`` and one row of ``counts``.

    Messages count that are no noise, of the window, not excluded, in threads without a sensitive
    message.  Claims keep the citations that are evidence and fall without any; their ``label`` is
    that of their project now, if it is not blank (project, label).  Exclusions name the threads and
    messages that the user took out and the threads that only their sensitivity keeps out.
    """
    threads = messages.select("thread_id").limit(0) if excluded_threads is None else excluded_threads.select("thread_id").distinct()
    single = messages.select("message_id").limit(0) if excluded_messages is None else excluded_messages.select("message_id").distinct()
    left = messages.join(threads, "thread_id", "left_anti").join(single, "message_id", "left_anti")
    # the gate looks at whole threads, so it stands before what is taken out
    gated = scope.sensitive_threads(messages)
    reachable = scope.in_window(left.where(~F.col("noise")), first, last)
    allowed = reachable.join(gated, "thread_id", "left_anti")
    claimed = scope.claims(events, allowed, projects)
    held = scope.evidence(claimed, messages)
    named = labels.where(F.trim("label") != "").select("project", F.trim("label").alias("label"))
    claimed = claimed.join(named, "project", "left")
    row = lambda rows, kind, target, ref: rows.select(F.lit(kind).alias("exclusion"), F.lit(target).alias("target"), F.col(ref).cast("string").alias("ref"))
    kept_out = reachable.join(gated, "thread_id", "left_semi").select("thread_id").distinct()
    exclusions = row(threads, "user_removed", "thread", "thread_id").unionByName(row(single, "user_removed", "message", "message_id")).unionByName(row(kept_out, "sensitivity", "thread", "thread_id"))
    parts = {"claims": claimed, "evidence": held, "excluded_sensitivity": kept_out, "excluded_user": exclusions.where("exclusion = 'user_removed'")}
    counts = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias(name))
        counts = one if counts is None else counts.join(F.broadcast(one), how="cross")  # one row each
    return {"claims": claimed, "evidence": held, "exclusions": exclusions, "counts": counts}
