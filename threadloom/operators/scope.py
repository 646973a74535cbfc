"""What may be shown or packaged: gates of threads, scopes, citations, liveness, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types as claim kinds; other types are plain updates.  Fixed values
CLAIM_KINDS = {"decision": "decision", "blocker": "blocker", "commitment": "commitment", "status_change": "status", "deadline": "deadline"}


def clean(sensitivity: Column) -> Column:
    """True only for exactly the tag ``none``."""
    return sensitivity == F.array(F.lit("none"))


def readable(messages: DataFrame, with_noise: bool = False, with_sensitive: bool = False) -> DataFrame:
    """Messages that a search may return, noise and sensitive ones only on demand."""
    rows = messages if with_noise else messages.where(~F.col("noise"))
    return rows if with_sensitive else rows.where(clean(F.col("sensitivity")))


def sensitive_threads(messages: DataFrame) -> DataFrame:
    return messages.where(~clean(F.col("sensitivity"))).select("thread_id").distinct()


def open_threads(messages: DataFrame, need_clean: bool = True) -> DataFrame:
    """Threads without any sensitive message and, on demand, with one that is no noise: one aggregate."""
    gate = messages.groupBy("thread_id").agg(F.max((~F.col("noise")).cast("int")).alias("some"), F.max((~clean(F.col("sensitivity"))).cast("int")).alias("bad"))
    return gate.where((F.col("bad") == 0) & (F.col("some") == 1) if need_clean else F.col("bad") == 0).select("thread_id")


def safe_sources(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """Messages among ``headers`` (message_id) that are clean and have no sensitive message in their thread."""
    asked = messages.join(headers.select("message_id").distinct(), "message_id", "left_semi").where(clean(F.col("sensitivity")))
    return asked.join(sensitive_threads(messages), "thread_id", "left_anti")


def in_window(messages: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Messages of the days from ``first`` to ``last``, whatever the gates say."""
    rows = messages if first is None else messages.where(F.col("ts") >= F.lit(first).cast("timestamp"))
    return rows if last is None else rows.where(F.col("ts") < F.lit(last).cast("timestamp") + F.expr("interval 1 day"))


def in_scope(messages: DataFrame, first: str | None = None, last: str | None = None, threads: DataFrame | None = None, project_threads: DataFrame | None = None, people: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Messages of a package: no noise, inside the window, of the threads or else the projects' threads,
    touching the people if any are named, not excluded, in threads without sensitive messages."""
    rows = in_window(messages.where(~F.col("noise")), first, last)
    chosen = threads if threads is not None else project_threads
    if chosen is not None:
        rows = rows.join(chosen.select("thread_id").distinct(), "thread_id", "left_semi")
    if people is not None:
        rows = rows.join(people.select("person_id").distinct(), F.col("sender") == F.col("person_id"), "left_semi")
    if excluded is not None:
        rows = rows.join(excluded.select("message_id").distinct(), "message_id", "left_anti")
    return rows.join(sensitive_threads(messages), "thread_id", "left_anti")


def empty_reason(messages: DataFrame, scoped: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """One row: ``ok``, ``filtered`` (the window holds messages, the gates let none through) or ``empty_window``."""
    counts = scoped.agg(F.count("*").alias("scoped")).join(F.broadcast(in_window(messages, first, last).agg(F.count("*").alias("windowed"))), how="cross")
    return counts.withColumn("code", F.when(F.col("scoped") > 0, "ok").when(F.col("windowed") > 0, "filtered").otherwise("empty_window"))


def claims(events: DataFrame, allowed: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """Claims from events (event_id, type, project, text, cites): citations trimmed to ``allowed``
    (message_id) and claims without any dropped; a project filter lets events without project pass."""
    rows = events if projects is None else events.where(F.col("project").isNull() | F.col("project").isin(projects))
    cited = rows.select("event_id", F.explode(F.array_distinct("cites")).alias("message_id")).join(allowed.select("message_id").distinct(), "message_id", "left_semi")
    kept = cited.groupBy("event_id").agg(F.sort_array(F.collect_list("message_id")).alias("cites"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in CLAIM_KINDS.items() for x in pair])[F.col("type")], F.lit("update"))
    return rows.drop("cites").join(kept, "event_id").withColumn("kind", kind)


def evidence(claimed: DataFrame, messages: DataFrame) -> DataFrame:
    """A frozen row for each cited message: id, thread, time, and the number of claims on it."""
    cited = claimed.select("event_id", F.explode("cites").alias("message_id")).groupBy("message_id").agg(F.count_distinct("event_id").alias("claims"))
    return cited.join(messages.select("message_id", "thread_id", "ts"), "message_id")


def frozen_labels(assigned: DataFrame, projects: DataFrame) -> DataFrame:
    """Labels of the projects as they are now, of the same mailbox and not blank (thread_id, project_id)."""
    named = projects.where(F.trim("label") != "").select("mailbox", "project_id", "label")
    return assigned.join(named, ["mailbox", "project_id"])


def exclusions(messages: DataFrame, threads: DataFrame, single: DataFrame) -> DataFrame:
    """(message_id, reason): of excluded threads, excluded themselves, or in sensitive threads; first reason wins."""
    by_thread = messages.join(threads.select("thread_id").distinct(), "thread_id", "left_semi").select("message_id", F.lit(1).alias("turn"))
    alone = messages.join(single.select("message_id").distinct(), "message_id", "left_semi").select("message_id", F.lit(2).alias("turn"))
    gated = messages.join(sensitive_threads(messages), "thread_id", "left_semi").select("message_id", F.lit(3).alias("turn"))
    first = by_thread.unionByName(alone).unionByName(gated).groupBy("message_id").agg(F.min("turn").alias("turn"))
    return first.select("message_id", F.element_at(F.array(F.lit("user_thread"), F.lit("user_message"), F.lit("sensitivity")), F.col("turn")).alias("reason"))


def leaked(claimed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Claims that cite an excluded message: must be none."""
    cited = claimed.select("event_id", F.explode("cites").alias("message_id"))
    return cited.join(excluded.select("message_id"), "message_id", "left_semi").select("event_id").distinct()


def may_publish(findings: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """For each package the high findings not acknowledged with a reason, and whether it may be published."""
    high = findings.where("severity = 'high'").select("package_id", "finding_id").distinct()
    known = acknowledged.where(F.trim("reason") != "").select("package_id", "finding_id").distinct()
    left = high.join(known, ["package_id", "finding_id"], "left_anti").groupBy("package_id").agg(F.count("*").alias("open"))
    return findings.select("package_id").distinct().join(left, "package_id", "left").select("package_id", F.coalesce("open", F.lit(0)).alias("open"), F.col("open").isNull().alias("may_publish"))


def live(status: Column, revoked: Column, expires: Column, now: Column) -> Column:
    """Published, not revoked, and not yet expired (the moment of expiry blocks)."""
    return (status == "published") & revoked.isNull() & (expires.isNull() | (now < expires))


def of_tenant(rows: DataFrame, mailboxes: DataFrame, tenant: int) -> DataFrame:
    """Rows whose mailbox belongs to the tenant."""
    return rows.join(mailboxes.where(F.col("tenant_id") == tenant).select("mailbox"), "mailbox", "left_semi")


def owned(mailboxes: DataFrame, mailbox: Column, owner: Column, tenant: Column) -> DataFrame:
    """The mailbox if owner and tenant are right; no row otherwise."""
    return mailboxes.where((F.col("mailbox") == mailbox) & (F.col("owner") == owner) & (F.col("tenant_id") == tenant))


def masked(value: Column, full: Column) -> Column:
    """The value for who may see all of it, else its first sign and three stars."""
    return F.when(full, value).otherwise(F.concat(F.substring(value, 1, 1), F.lit("***")))


def sole_actor(events: DataFrame, owner: Column, most: float = 0.3) -> DataFrame:
    """Events whose only actor is the owner need evidence, and then keep at most the confidence ``most``."""
    alone = F.col("actor") == owner
    return events.where(~alone | F.col("evidenced")).withColumn("confidence", F.when(alone, F.least("confidence", F.lit(most))).otherwise(F.col("confidence")))
