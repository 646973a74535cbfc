"""Evidence of both searches, returns, forks and candidates of packages on small tables."""

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from threadloom.operators import evidence, returns

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
MESSAGES = [
    (1, 10, datetime(2024, 2, 1), False, ["none"], "ann@x", ["bob@x", None]), (2, 10, datetime(2024, 1, 1), False, ["none"], "zed@x", None), (3, 11, datetime(2024, 2, 29), True, ["none"], "ann@x", []), (4, 12, datetime(2024, 2, 1), False, ["hr", "none"], "ann@x", []), (5, 13, datetime(2024, 3, 9), None, None, "q@x", []),
]


@pytest.fixture(scope="module")
def linked(spark):
    messages = spark.createDataFrame(MESSAGES, "id long, thread long, ts timestamp, noise boolean, sensitivity array<string>, sender string, recipients array<string>")
    assigned = spark.createDataFrame([(10, "p2"), (10, "p1"), (12, "p1")], "thread long, project string")
    identities = spark.createDataFrame([("ann@x", "A"), ("bob@x", "B"), ("zed@x", None)], "email string, person string")
    return lambda hits: evidence.linked(spark.createDataFrame(hits, "query_id long, id long, score double"), messages, assigned, identities)


def test_hits_know_their_projects_and_people(linked):
    got = {r.id: (r.projects, r.people) for r in linked([(0, i, 0.5) for i in range(1, 7)]).collect()}
    assert got == {1: (["p1", "p2"], ["A", "B"]), 2: (["p1", "p2"], []), 3: ([], ["A"]), 4: (["p1"], ["A"]), 5: ([], [])}
    hits = linked([(0, i, 0.5) for i in range(1, 6)])
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(evidence.readable_hits(hits)) == [1, 2, 5] and ids(evidence.readable_hits(hits, noise=True)) == [1, 2, 3, 5] and ids(evidence.readable_hits(hits, sensitive=True)) == [1, 2, 4, 5]


def test_scores(linked):
    vector, text = linked([(0, 1, 0.9), (0, 2, 0.7), (0, 3, 0.59), (1, 2, 0.3)]), linked([(0, 2, 0.2), (0, 5, 0.2)])
    got = {(r.query_id, r.id): r for r in evidence.evidence(vector, text, NOW).collect()}
    age = lambda i: max(0.0, (NOW.replace(tzinfo=None) - MESSAGES[i - 1][2]).total_seconds() / 86_400)
    want = {1: 0.6 + 0.25 + 0.05 * math.exp(-age(1) / 180), 2: 0.0 + 0.4 + 0.15 + 0.05 * math.exp(-age(2) / 180), 5: 0.4 + 0.05}
    assert {i: got[0, i].score for i in want} == pytest.approx(want, abs=1e-6) and len(got) == 3
    assert {i: got[0, i].source for i in want} == {1: "vector", 2: "hybrid", 5: "fts"} and [got[0, i].rank for i in (1, 2, 5)] == [1, 2, 3]
    assert evidence.evidence(vector, text, NOW, most=1).count() == 1


def test_reranker(spark, linked):
    found = evidence.evidence(linked([(0, 1, 0.9), (0, 2, 0.7)]), linked([(0, 5, 0.2)]), NOW)
    order = lambda rows: spark.createDataFrame(rows, "query_id long, id long, score double")
    got = evidence.reranked(found, order([(0, 5, 9.0), (0, 1, 8.0)])).orderBy("rank").collect()
    assert [(r.id, r.score, r.source) for r in got] == [(5, 9.0, "fts"), (1, 8.0, "vector")]
    for wrong in ([(0, 3, 1.0)], [(0, 1, 1.0), (0, 1, 2.0)], [(1, 1, 1.0)]):
        with pytest.raises(ValueError):
            evidence.reranked(found, order(wrong))


def test_returns(spark):
    scopes = spark.createDataFrame([("k1", "m1", ["p1"], ["A"], ["Co.com"]), ("k2", "m1", None, ["A"], []), ("k3", "m1", ["p9"], None, ["co.com"]), ("k4", "m1", None, None, None)], "package string, mailbox string, projects array<string>, people array<string>, domains array<string>")
    claims = spark.createDataFrame([("k1", "p2"), ("k1", None)], "package string, project string")
    seen = spark.createDataFrame([("k1", "X.org"), ("k1", None), ("k1", "")], "package string, sender_domain string")
    projects = spark.createDataFrame([("m1", "p1", "Nexus Team"), ("m1", "p2", "SOC2 audit"), ("m1", "p9", "The Project"), ("m2", "c1", "nexus rollout"), ("m2", "c2", "team project"), ("m2", "c3", None), ("m3", "c4", "audit")], "mailbox string, project string, label string")
    ids = spark.createDataFrame([("m1", "A", "Ann@Z.com"), ("m2", "ann", "ann@z.com"), ("m2", "bob", "bob@co.com"), ("m2", None, "x@co.com"), ("m2", "xe", "e@x.org"), ("m2", "odd", "nohost")], "mailbox string, person string, email string")
    asked = spark.createDataFrame([(1, "k1", "m2"), (2, "k2", "m2"), (3, "k3", "m2"), (4, "k4", "m2"), (5, "k1", "m3"), (6, "gone", "m2")], "return_id long, package string, mailbox string")
    got = {r.return_id: r for r in returns.return_scope(asked, scopes, claims, seen, projects, ids).collect()}
    assert (got[1].projects, got[1].people, got[1].method) == (["c1"], [], "mixed")
    assert (got[1].carried_projects, got[1].carried_people, got[1].domains, got[1].labels) == (["p1", "p2"], ["A"], ["co.com", "x.org"], ["Nexus Team", "SOC2 audit"])
    assert (got[2].projects, got[2].people, got[2].method) == ([], ["ann"], "snapshot_hints")
    assert (got[3].projects, got[3].people, got[3].method) == ([], ["bob"], "mixed")
    assert (got[4].projects, got[4].people, got[4].method) == ([], [], "snapshot_hints") == (got[6].projects, got[6].people, got[6].method)
    assert (got[5].projects, got[5].people, got[5].method) == (["c4"], [], "structured")


def test_forks(spark):
    packages = spark.createDataFrame([("k1", "l1", 1, "published", "ann"), ("k2", "l1", 2, "revoked", "ann"), ("k3", "l2", 5, "draft", "bob")], "package string, lineage string, version long, status string, creator string")
    scopes = spark.createDataFrame([("k1", "a"), ("k3", "b")], "package string, first string")
    asked = spark.createDataFrame([("k1", "n2"), ("k2", "n1"), ("k3", "n3"), ("k9", "n4")], "package string, new string")
    drafts, copied = returns.forked(packages, scopes, asked)
    assert {(r.package, r.lineage, r.version, r.status, r.forked_from, r.creator) for r in drafts.collect()} == {("n1", "l1", 3, "draft", "k2", "ann"), ("n2", "l1", 4, "draft", "k1", "ann"), ("n3", "l2", 6, "draft", "k3", "bob")}
    assert {tuple(r) for r in copied.collect()} == {("n2", "a"), ("n3", "b")}


def test_candidate(spark):
    rows = [(1, 10, 1, "2024-01-02", False, ["none"]), (2, 10, 1, "2024-01-03", True, ["none"]), (3, 11, 1, "2024-01-03", False, ["hr"]), (4, 12, 1, "2024-01-04", False, ["none"]), (5, 13, 1, "2024-01-04", False, ["none"]), (6, 14, 1, "2024-05-04", False, ["none"])]
    messages = spark.createDataFrame(rows, "message_id long, thread_id long, sender long, ts string, noise boolean, sensitivity array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    events = spark.createDataFrame([(1, "did", "p", [1, 2, 6]), (2, "did", None, [3]), (3, "outcome", "q", [5]), (4, "did", "r", [1]), (5, "did", "p", [4, 1])], "event_id long, type string, project string, cites array<long>")
    labels = spark.createDataFrame([("p", " Nexus "), ("q", " ")], "project string, label string")
    got = returns.assembled(events, messages, labels, "2024-01-01", "2024-01-31", ["p", "q"], spark.createDataFrame([(13,)], "thread_id long"), spark.createDataFrame([(4,)], "message_id long"))
    assert {(r.event_id, tuple(r.cites), r.label) for r in got["claims"].collect()} == {(1, (1,), "Nexus"), (5, (1,), "Nexus")}
    assert [(r.message_id, r.claims) for r in got["evidence"].collect()] == [(1, 2)]
    assert {tuple(r) for r in got["exclusions"].collect()} == {("user_removed", "thread", "13"), ("user_removed", "message", "4"), ("sensitivity", "thread", "11")}
    assert tuple(got["counts"].first()) == (2, 1, 1, 2)
    assert tuple(returns.assembled(events, messages.limit(0), labels)["counts"].first()) == (0, 0, 0, 0)
