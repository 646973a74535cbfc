"""The modes of the relationship map on a small mailbox."""

from datetime import datetime, timezone

import pytest

from threadloom.operators import relmap

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def box(spark):
    day = lambda m: datetime(2024, m, 1)
    return (
        spark.createDataFrame([("ann", 3, day(1), day(5)), ("bob", 1, day(1), day(1)), ("cid", 0, None, None)], "person string, headers long, first_seen timestamp, last_seen timestamp"),
        spark.createDataFrame([(1, "ann", day(1), day(2)), (1, "bob", day(1), day(2)), (2, "ann", day(3), day(4)), (2, "bob", day(3), day(4)), (2, "dan", day(3), day(4)), (2, "dan", day(3), day(4))], "thread long, person string, start timestamp, end timestamp"),
        spark.createDataFrame([("p", "ann", 2.5), ("p", "dan", 0.1), ("q", "ann", 1.0), ("q", "eve", 4.0)], "project string, person string, involvement double"),
        spark.createDataFrame([("p", "Beta", 0.5, day(1), day(5)), ("q", "Alpha", 0.5, None, None)], "project string, label string, confidence double, start timestamp, end timestamp"),
        spark.createDataFrame([("ann", "X.com"), ("bob", ""), ("dan", "x.com"), ("eve", None), ("zed", "x.com")], "person string, domain string"),
    )


def edges(df):
    return {(r.type, r.a, r.b): (r.weight, r.evidence, r.muted) for r in df.collect()}


def test_owner(box):
    found, nodes = relmap.relationship_map("owner", *box, now=NOW)
    assert edges(found) == {("direct_exchange", "owner", "person:ann"): (3.0, 3, False), ("direct_exchange", "owner", "person:bob"): (1.0, 1, False), ("thread_copresence", "person:ann", "person:bob"): (2.0, 2, False)}
    assert {tuple(r) for r in nodes.collect()} == {("owner", "owner"), ("person:ann", "person"), ("person:bob", "person")}
    few, nodes = relmap.relationship_map("owner", *box, types=["bridge"])
    assert few.count() == 0 and [r.id for r in nodes.collect()] == ["owner"]
    recent, _ = relmap.relationship_map("owner", *box, now=NOW, days=40, least_weight=2)
    assert edges(recent) == {("direct_exchange", "owner", "person:ann"): (3.0, 3, False)}


def test_project(spark, box):
    found, nodes = relmap.relationship_map("project", *box, project=spark.createDataFrame([("p",)], "project string"))
    assert edges(found) == {
        ("project_copresence", "project:p", "person:ann"): (2.5, 1, False), ("project_copresence", "project:p", "person:dan"): (0.1, 1, True), ("thread_copresence", "person:ann", "person:dan"): (1.0, 1, False), ("project_copresence", "person:ann", "person:dan"): (1.0, 1, False),
        ("org_affiliation", "person:ann", "org:x.com"): (1.0, 1, False), ("org_affiliation", "person:dan", "org:x.com"): (1.0, 1, False),
    }
    assert {r.node_type for r in nodes.collect()} == {"project", "person", "organization"}
    default, _ = relmap.relationship_map("project", *box)
    assert ("project_copresence", "project:q", "person:eve") in edges(default)


def test_org_and_graph(box):
    found, _ = relmap.relationship_map("org", *box)
    assert set(edges(found)) == {("org_affiliation", "org:x.com", "person:ann"), ("org_affiliation", "org:x.com", "person:dan")}
    assert [(r.id, r.members) for r in relmap.org_members(found).collect()] == [("org:x.com", ["person:ann", "person:dan"])]
    found, nodes = relmap.relationship_map("graph", *box)
    got = edges(found)
    assert got["bridge", "person:ann", "project:p"] == (2.0, 2, False) == got["bridge", "person:ann", "project:q"] and got["project_copresence", "person:ann", "person:eve"] == (1.0, 1, False)
    assert {k[0] for k in got} == set(relmap.TYPES) and "owner" in {r.id for r in nodes.collect()}
    with pytest.raises(ValueError):
        relmap.relationship_map("tree", *box)
    with pytest.raises(ValueError):
        relmap.relationship_map("graph", *box, types=["love"])


def test_empty(box):
    none = [t.limit(0) for t in box]
    for mode in relmap.MODES:
        found, nodes = relmap.relationship_map(mode, *none)
        assert found.count() == 0 and nodes.count() == (mode == "owner")


def test_large_groups_meet_in_chunks(spark):
    members = spark.createDataFrame([(g, p, None, None) for g in range(2) for p in range(30 + g)], "grp long, person long, start timestamp, end timestamp")
    rows = lambda n: sorted(map(str, relmap.together(members, "x", n).collect()))
    assert rows(4) == rows(256) and len(rows(4)) == 31 * 30 // 2
