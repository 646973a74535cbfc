"""Identities: the piece join against all pairs, equal names, addresses without names."""

import random

from threadloom.operators import mailbox

COLUMNS = "id string, block string, name string"


def altered(name, rng):
    text = list(name)
    for _ in range(rng.randrange(1, 4)):
        i = rng.randrange(len(text) + 1)
        text[i : i + rng.randrange(2)] = rng.choice(["", "x", "o"])
    return "".join(text)


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    names = base + [altered(n, rng) for n in base for _ in range(3)] + [n.upper() for n in base[:5]] + ["", None]
    rows = [(f"{i:03}", "ab"[i % 2], n) for i, n in enumerate(names)] + [(f"{i:03}b", "ab"[i % 2], n) for i, n in enumerate(names)]
    for least in (80.0, 92.0):
        got = {(r.name_a, r.name_b, r.a[:0]) for r in mailbox.similar_names(spark.createDataFrame(rows, COLUMNS), least).collect()}
        want = set()
        for block in "ab":
            low = sorted({n.lower() for _, b, n in rows if b == block and n})
            want |= {(x, y, "") for x in low for y in low if x < y and round(mailbox.indel_ratio(x, y), 4) >= least}
        assert got == want and len(want) > 40


def test_identities(spark):
    rows = [("a@x", "x", "Anna Lindqvist"), ("b@x", "x", "anna lindqvist"), ("c@x", "x", "Anna Lindqvists"), ("d@x", "x", "Bo Ek"), ("a@y", "y", "Anna Lindqvist"), ("e@x", "x", None), ("d@x", "x", "Anders Ek"), ("f@x", "x", "anders ek"), ("a@x", "x", "Anna Lindqvist")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = mailbox.identities(df)
    assert {r.id: r.person for r in got.collect()} == {"a@x": "a@x", "b@x": "a@x", "c@x": "a@x", "d@x": "d@x", "a@y": "a@y", "e@x": "e@x", "f@x": "d@x"}
    people = {r.person: (r.names, r.identities) for r in mailbox.persons(df, got).collect()}
    assert people["d@x"] == (["Anders Ek", "Bo Ek", "anders ek"], ["d@x", "f@x"]) and people["e@x"] == ([], ["e@x"])
    assert mailbox.identities(df.limit(0)).count() == 0
    assert {(r.domain, r.internal) for r in mailbox.orgs(df, ["X"]).collect()} == {("x", True), ("y", False)}


def test_display_names_in_order_of_mention(spark):
    rows = [("a", "B", 2), ("a", "A", 3), ("a", "B", 5), ("a", "", 1), ("b", None, 1)]
    got = {r.email: r.names for r in mailbox.display_names(spark.createDataFrame(rows, "email string, name string, at long")).collect()}
    assert got == {"a": ["B", "A"], "b": []}
