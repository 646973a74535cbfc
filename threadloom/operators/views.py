"""What is served about contacts and projects: details, lists, activity.

Every view is a table for all contacts or projects of all mailboxes at once; a page reads its rows of
it.  ``now`` is given, so that a view of stored tables can be repeated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days after which a project is stale, threads and people a page shows, order of the kinds of events
STALE_DAYS, RECENT, TO_ASK = 30, 10, 4
GRADES = {"outcome": 0, "did": 1, "proposed": 2}


def _ranked(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def person_name(names: Column, email: Column) -> Column:
    return F.coalesce(F.get(names, F.lit(0)), email)


def contacts(people: DataFrame, identities: DataFrame, edges: DataFrame, orgs: DataFrame) -> DataFrame:
    """One row for each person with an edge: name, addresses in order, organisation, and the edge.

    ``people`` are mailbox, person, names (array), email, role and org; ``identities`` mailbox,
    person and email; ``edges`` mailbox, person, weight and counts; ``orgs`` org and domain.
    """
    emails = identities.where("person is not null").groupBy("mailbox", "person").agg(F.array_sort(F.collect_set("email")).alias("all_emails"))
    rows = people.join(edges, ["mailbox", "person"]).join(emails, ["mailbox", "person"], "left").join(orgs.select("org", F.col("domain").alias("org_domain")), "org", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("name", person_name(F.col("names"), F.col("email"))).withColumn("all_emails", F.coalesce("all_emails", none)).drop("names", "org")


def contact_threads(contacts: DataFrame, threads: DataFrame, messages: DataFrame, owners: DataFrame, most: int = RECENT) -> DataFrame:
    """(mailbox, person, rank, thread, subject, others, last, messages): the newest threads that owner and contact share.

    ``threads`` are mailbox, thread, subject, participants (array) and last, ``owners`` mailbox and
    owner (an address).  A contact is in a thread by any of its addresses; ``others`` are the rest, in
    order.  Of equal ends the smaller thread comes first.
    """
    addresses = contacts.select("mailbox", "person", F.explode(F.when(F.size("all_emails") > 0, F.col("all_emails")).otherwise(F.array("email"))).alias("address"))
    owned = threads.join(owners, "mailbox").where(F.array_contains("participants", F.col("owner")))
    met = owned.select("mailbox", "thread", F.explode("participants").alias("address")).join(addresses, ["mailbox", "address"]).select("mailbox", "thread", "person").distinct()
    newest = _ranked(met.join(owned.select("mailbox", "thread", "last"), ["mailbox", "thread"]), ["mailbox", "person"], [F.desc("last"), "thread"], most)
    counted = messages.groupBy("mailbox", "thread").agg(F.count("*").alias("messages"))
    full = newest.drop("last").join(owned, ["mailbox", "thread"]).join(counted, ["mailbox", "thread"], "left")
    own = addresses.groupBy("mailbox", "person").agg(F.collect_set("address").alias("own"))
    others = F.array_sort(F.array_except(F.array_except("participants", "own"), F.array("owner")))
    return full.join(own, ["mailbox", "person"]).select("mailbox", "person", "rank", "thread", "subject", others.alias("others"), "last", F.coalesce("messages", F.lit(0)).alias("messages"))


def activity(events: DataFrame, messages: DataFrame) -> DataFrame:
    """(project, place, event, type, actor, cites, confidence, at): events with citations in their order.

    Outcomes come first, then what was done, then proposals; of one kind the newest first by the last
    cited message that is stored, those without one last; then by event.
    """
    cited = events.select("event", F.explode("cites").alias("message")).join(messages.select("message", "ts"), "message").groupBy("event").agg(F.max(F.col("ts").cast("timestamp")).alias("at"))
    rows = events.where("project is not null and size(cites) > 0").join(cited, "event", "left").withColumn("at", F.coalesce("at", F.timestamp_seconds(F.lit(0))))
    grade = F.coalesce(F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair])[F.col("type")], F.lit(99))
    place = Window.partitionBy("project").orderBy(grade, F.desc("at"), "event")
    return rows.withColumn("place", F.row_number().over(place)).select("project", "place", "event", "type", "actor", "cites", "confidence", "at")


def _age(now: datetime, at: Column) -> Column:
    """Whole days from ``at`` to now."""
    return F.floor((F.lit(now.timestamp()) - F.unix_micros(at.cast("timestamp")) / 1e6) / 86_400)


def project_list(projects: DataFrame, assigned: DataFrame, members: DataFrame, threads: DataFrame, events: DataFrame, messages: DataFrame, now: datetime) -> DataFrame:
    """One row for each project: place by confidence, label and id, state, members, threads, last activity.

    A project without threads, or whose last one ended more than ``STALE_DAYS`` ago, is stale; one
    with an outcome as new as that is shipping; others are active.  ``projects`` are project, label,
    confidence and end, ``assigned`` project and thread, ``members`` project and person.
    """
    own = assigned.select("project", "thread").distinct()
    ends = own.join(threads.select("thread", "last"), "thread", "left").groupBy("project").agg(F.count("*").alias("threads"), F.max("last").alias("last"))
    people = members.groupBy("project").agg(F.count("*").alias("members"))
    fresh = activity(events, messages).where((F.col("type") == "outcome") & (F.unix_micros(F.col("at").cast("timestamp")) / 1e6 >= now.timestamp() - STALE_DAYS * 86_400)).select("project").distinct().withColumn("ships", F.lit(True))
    rows = projects.join(ends, "project", "left").join(people, "project", "left").join(fresh, "project", "left")
    state = F.when(F.col("last").isNull() | (_age(now, F.col("last")) > STALE_DAYS), "stale").when(F.col("ships"), "shipping").otherwise("active")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("project", "label", state.alias("state"), "confidence", zero("members"), zero("threads"), F.coalesce("last", "end").alias("last_activity"))


def in_order(listed: DataFrame, mailbox: DataFrame) -> DataFrame:
    """Projects with their ``place`` on the list of their mailbox (project, mailbox)."""
    place = Window.partitionBy("mailbox").orderBy(F.desc("confidence"), "label", "project")
    return listed.join(mailbox.select("project", "mailbox"), "project").withColumn("place", F.row_number().over(place))


def project_people(members: DataFrame, people: DataFrame, weights: DataFrame, most: int = TO_ASK) -> DataFrame:
    """(project, person, name, role, messages, involvement, weight, place, ask): members by involvement, whom to ask.

    ``members`` are project, person, involvement and messages, ``people`` person, names, email and
    role, ``weights`` person and weight, the owner's edges.  ``ask`` is 1 to ``most`` for the members
    with the heaviest edge, then most involvement, null for others; people that are not known have
    their id as a name.
    """
    rows = members.join(people.select("person", "names", "email", "role"), "person", "left").join(weights.groupBy("person").agg(F.max("weight").alias("weight")), "person", "left")
    weight = F.round(F.coalesce("weight", F.lit(0.0)), 4)
    rows = rows.withColumn("weight", weight)
    place = Window.partitionBy("project").orderBy(F.desc("involvement"), "person")
    ask = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("weight"), F.desc("involvement"), "person"))
    name = F.coalesce(person_name(F.col("names"), F.col("email")), F.col("person").cast("string"))
    rows = rows.withColumn("place", F.row_number().over(place)).withColumn("ask", ask)
    return rows.select("project", "person", name.alias("name"), F.coalesce("role", F.lit("unknown")).alias("role"), "messages", "involvement", "weight", "place", F.when(F.col("ask") <= most, F.col("ask")).alias("ask"))


def project_threads(assigned: DataFrame, threads: DataFrame, most: int = RECENT) -> DataFrame:
    """(project, rank, thread, subject, participants, last): the newest threads of each project."""
    rows = assigned.select("project", "thread").distinct().join(threads.select("thread", "subject", "participants", "last"), "thread")
    return _ranked(rows, ["project"], [F.desc("last"), "thread"], most).select("project", "rank", "thread", "subject", "participants", "last")
