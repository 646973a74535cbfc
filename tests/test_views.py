"""Views of contacts and projects on small tables with gaps and ties."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from threadloom.operators import views

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)


def day(n):
    return datetime(2024, 1, 1) if n is None else datetime(2024, 2, n)


def test_contacts(spark):
    people = spark.createDataFrame([("m", "p", ["Ann", "A."], "ann@x.com", "peer", 1), ("m", "q", [], "q@x.com", None, None), ("m", "r", None, "r@x.com", "lead", 2)], "mailbox string, person string, names array<string>, email string, role string, org long")
    ids = spark.createDataFrame([("m", "p", "b@x.com"), ("m", "p", "ann@x.com"), ("m", None, "z@x.com")], "mailbox string, person string, email string")
    edges = spark.createDataFrame([("m", "p", 0.5), ("m", "q", 0.1)], "mailbox string, person string, weight double")
    orgs = spark.createDataFrame([(1, "x.com")], "org long, domain string")
    found = views.contacts(people, ids, edges, orgs)
    got = {r.person: (r.name, r.all_emails, r.org_domain, r.weight) for r in found.collect()}
    assert got == {"p": ("Ann", ["ann@x.com", "b@x.com"], "x.com", 0.5), "q": ("q@x.com", [], None, 0.1)}
    rows = [("m", i, f"s{i}", ["me@x.com", "b@x.com" if i % 2 else "ann@x.com", "c@x.com"], day(1 + i // 2)) for i in range(12)]
    rows += [("m", 50, "s", ["b@x.com"], day(20)), ("m", 51, "s", ["me@x.com", "q@x.com"], day(3))]
    threads = spark.createDataFrame(rows, "mailbox string, thread long, subject string, participants array<string>, last timestamp")
    messages = spark.createDataFrame([("m", 11), ("m", 11), ("m", 51)], "mailbox string, thread long")
    owners = spark.createDataFrame([("m", "me@x.com")], "mailbox string, owner string")
    got = views.contact_threads(found, threads, messages, owners).orderBy("person", "rank").collect()
    assert [r.thread for r in got if r.person == "p"] == [10, 11, 8, 9, 6, 7, 4, 5, 2, 3] and [r.thread for r in got if r.person == "q"] == [51]
    assert got[1].messages == 2 and got[0].messages == 0 and got[0].others == ["c@x.com"] and got[-1].others == []


def test_projects(spark):
    events = spark.createDataFrame(
        [(1, "a", "did", 7, ["x"], 0.5), (2, "a", "outcome", 7, ["y", "gone"], 0.5), (3, "a", "outcome", 7, ["x", "y"], 0.5), (4, "a", "proposed", 7, [], 0.5), (5, "a", "other", 7, ["gone"], 0.5), (6, None, "did", 7, ["x"], 0.5), (7, "b", "outcome", 7, ["old"], 0.5)],
        "event long, project string, type string, actor long, cites array<string>, confidence double",
    )
    messages = spark.createDataFrame([("x", day(20)), ("y", day(10)), ("old", day(None))], "message string, ts timestamp")
    got = views.activity(events, messages).orderBy("project", "place").collect()
    assert [r.event for r in got] == [3, 2, 1, 5, 7] and [r.place for r in got] == [1, 2, 3, 4, 1]
    projects = spark.createDataFrame([("a", "L", 0.5, None), ("b", "L", 0.9, None), ("c", "K", 0.5, day(5)), ("d", "M", 0.1, None)], "project string, label string, confidence double, end timestamp")
    assigned = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), ("d", 3)], "project string, thread long")
    threads = spark.createDataFrame([(1, "s1", ["z"], day(25)), (2, "s2", ["z"], day(1)), (3, "s3", ["z"], day(None))], "thread long, subject string, participants array<string>, last timestamp")
    members = spark.createDataFrame([("a", 1, 2.0, 3), ("a", 2, 2.0, 1), ("a", 3, 9.0, 1), ("b", 1, 1.0, 1)], "project string, person long, involvement double, messages long")
    listed = views.project_list(projects, assigned, members, threads, events, messages, NOW)
    got = {r.project: (r.state, r.members, r.threads, r.last_activity) for r in listed.collect()}
    assert got == {"a": ("shipping", 3, 2, day(25)), "b": ("active", 1, 1, day(1)), "c": ("stale", 0, 0, day(5)), "d": ("stale", 0, 1, day(None))}
    placed = views.in_order(listed, projects.select("project", F.lit(1).alias("mailbox")))
    assert [r.project for r in placed.orderBy("place").collect()] == ["b", "c", "a", "d"]
    people = spark.createDataFrame([(1, ["Ann"], "a@x", "peer"), (2, None, "b@x", None)], "person long, names array<string>, email string, role string")
    weights = spark.createDataFrame([(2, 0.7), (1, 0.7)], "person long, weight double")
    got = views.project_people(members, people, weights, most=2).where("project = 'a'").orderBy("place").collect()
    assert [(r.person, r.name, r.role, r.ask) for r in got] == [(3, "3", "unknown", None), (1, "Ann", "peer", 1), (2, "b@x", "unknown", 2)]
    assert [(r.project, r.thread, r.rank) for r in views.project_threads(assigned, threads, 1).orderBy("project").collect()] == [("a", 1, 1), ("b", 2, 1), ("d", 3, 1)]
