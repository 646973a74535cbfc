"""Web searches against plain Python; stems of known words; claims and their areas against plain Python."""

import itertools
import math
import random
import re
from collections import defaultdict

import pytest

from threadloom.operators import areas, search

STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolingly": "consol",
    "knack": "knack", "knees": "knee", "kneeling": "kneel", "knightly": "knight", "knitting": "knit", "knots": "knot", "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "this": "this", "agreed": "agre", "feed": "feed",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "hoping": "hope", "falling": "fall", "failing": "fail", "filing": "file", "happy": "happi", "by": "by", "say": "say", "enjoy": "enjoy",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valency": "valenc", "digitizer": "digit", "radically": "radic", "differently": "differ", "analogously": "analog", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "sensitivity": "sensit", "sensibility": "sensibl", "formative": "format", "electrical": "electr", "goodness": "good", "revival": "reviv", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "communism",
    "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "rolling": "roll", "generate": "generat", "general": "general", "generously": "generous", "communication": "communic", "skies": "sky", "dying": "die",
    "news": "news", "succeeds": "succeed", "outing": "outing", "youth": "youth", "boyish": "boyish", "meetings": "meet", "deployed": "deploy", "reviews": "review", "policies": "polici", "technology": "technolog", "kindly": "kind", "a": "a", "as": "as",
}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "word string")
    got = {r.word: r.stem for r in search.stemmed(rows).collect()}
    assert {w: s for w, s in got.items() if s != STEMS[w]} == {}


def parsed(text):
    out = [[]]
    for part in re.findall(r'-?"[^"]*"?|[^\s"]+', text.lower()):
        if part == "or":
            out.append([])
        else:
            words = re.findall(r"[^\W_]+", part)
            kept = [(i, w) for i, w in enumerate(words) if w not in search.STOP]
            if kept:
                out[-1].append((part.startswith("-"), [(i - kept[0][0], w) for i, w in kept]))
    return [x for x in out if x]


def brute(docs, queries, k):
    out = set()
    places = {i: [(p, w) for p, w in enumerate(re.findall(r"[^\W_]+", (t or "").lower()))] for i, t, _ in docs}
    ts = {i: t for i, _, t in docs}
    for q, text in queries:
        ways = parsed(text or "")
        terms = {w for way in ways for _, words in way for _, w in words}
        hits = []
        for i, have in places.items():
            at = set(have)
            holds = lambda words: any(all((p + d, w) in at for d, w in words) for p in range(len(have)))  # noqa: B023, E731
            if not any(all(holds(words) != negated for negated, words in way) for way in ways):
                continue
            own = defaultdict(list)
            for p, w in have:
                if w in terms:
                    own[w].append(p)
            if len(ways) == 1 and len(terms) > 1:
                keep = 1.0
                for a, b in itertools.combinations(sorted(own), 2):
                    for x, y in itertools.product(own[a], own[b]):
                        if abs(x - y) <= 100:
                            keep *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
                score = 1 - keep
            else:
                score = sum(0.1 * sum(1 / j**2 for j in range(1, len(v) + 1)) / 1.64493406685 for v in own.values()) / len(terms)
            hits.append((-round(score, 6), -ts[i], i))
        for rank, (score, _, i) in enumerate(sorted(hits)[:k], 1):
            out.add((q, i, round(-score, 6), rank))
    return out


QUERIES = ['"ka lo mi"', "ka lo mi", "ka or lo -mi", "-ka", 'zu "the ka" or "mi the lo', "the and", "", None, "lo-mi", '-"ka lo" mi', "ka", '"ka ka"', "OR ka or or -", "KA Lo"]


def test_web_search(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["ka", "lo", "mi", "the", "zu", "Ka,", "re"]) for _ in range(rng.choice([3, 8, 30, 300]))), rng.randrange(5)) for i in range(60)]
    docs += [(100, None, 1), (101, "", 2), (102, "ka lo mi " * 200, 3), (103, "lo mi", 9), (104, "LO mi", 9)]
    df = spark.createDataFrame(docs, "id long, text string, ts long")
    asked = list(enumerate(QUERIES))
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = {tuple(r) for r in search.web_search(df, queries, 15, stems=False).collect()}
    want = brute(docs, asked, 15)
    assert {(q, i, rank) for q, i, _, rank in got} == {(q, i, rank) for q, i, _, rank in want}
    scores = {(q, i): s for q, i, s, _ in want}
    assert all(s == pytest.approx(scores[q, i], abs=2e-6) for q, i, s, _ in got)
    assert search.web_search(df.limit(0), queries).count() == 0 and search.web_search(df, queries.limit(0)).count() == 0


def test_a_phrase_is_not_its_bag_of_words(spark):
    docs = spark.createDataFrame([(1, "renewal of the contract"), (2, "the contract renewals"), (3, "contracts renewed")], "id long, text string")
    queries = spark.createDataFrame([(1, '"contract renewal"'), (2, "contract renewal"), (3, "renewal -contract"), (4, '"renewal contract"')], "query_id long, text string")
    got = defaultdict(set)
    for r in search.web_search(docs, queries).collect():
        got[r.query_id].add(r.id)
    assert got == {1: {2, 3}, 2: {1, 2, 3}}


def linked(claims, evidence):
    """Areas by comparing all pairs of claims."""
    by = {(p, h): (place, s) for p, h, s, _, _, place in sorted(evidence, key=lambda e: e[5])}
    info = {}
    for p, c, text, _, cites in claims:
        heads = {h for h in cites or [] if (p, h) in by}
        words = {w for t in [text, *(by[p, h][1] for h in heads)] for w in re.findall("[a-z0-9]{3,}", (t or "").lower())} - set(areas.COMMON)
        info[p, c] = heads, words
    df = defaultdict(int)
    for (p, _), (_, words) in info.items():
        for w in words:
            df[p, w] += 1
    parent = {k: k for k in info}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(info), 2):
        if a[0] == b[0]:
            shared = info[a][1] & info[b][1]
            if info[a][0] & info[b][0] or len(shared) >= 2 or any(df[a[0], w] <= 2 for w in shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k)[1] for k in info}, info


def test_areas(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(30)] + ["the", "status", "on"]
    evidence = [(p, f"h{i}", rng.choice([None, " ", "the " + rng.choice(vocabulary), "Re: plan"]), rng.choice(["", "x.com", "X.com"]), rng.choice([None, "Ann", ""]), i) for p in (1, 2) for i in range(15)]
    claims = [(p, c, rng.choice([None, " ".join(rng.sample(vocabulary, rng.choice([1, 2, 3])))]), rng.choice(["decision", "open_loop", "did"]), rng.choice([None, [], [f"h{rng.randrange(20)}"], ["h1", f"h{rng.randrange(15)}"]])) for p in (1, 2) for c in range(25)]
    c = spark.createDataFrame(claims, "package_id long, claim_id long, text string, kind string, cites array<string>")
    e = spark.createDataFrame(evidence, "package_id long, header string, subject string, sender_domain string, sender_display string, place long")
    want, info = linked(claims, evidence)
    assert {(r.package_id, r.claim_id): r.area for r in areas.claim_areas(c, e).collect()} == want
    assert len(set(want.items())) < len(want) or len({(p, a) for (p, _), a in want.items()}) > 4
    by = {(p, h): row for row in evidence for p, h in [row[:2]]}
    rows = {}
    for p, area in {(p, a) for (p, _), a in want.items()}:
        own = [x for x in claims if x[0] == p and want[p, x[1]] == area]
        heads = sorted({h for x in own for h in info[p, x[1]][0]}, key=lambda h: by[p, h][5])
        people = {((by[p, h][3] or "").strip() or (by[p, h][4] or "").strip() or "Unknown sender").lower() for h in heads}
        label = next((by[p, h][2].strip() for h in heads if (by[p, h][2] or "").strip()), None) or (min(own, key=lambda x: x[1])[2] or "")[:60] or "Coverage area"
        rows[p, area] = (label, len(own), sum(x[3] == "decision" for x in own), sum(x[3] == "open_loop" for x in own), len(people), len(heads))
    got = areas.coverage_areas(c, e).collect()
    assert {(r.package_id, r.area): (r.label, r.claims, r.decisions, r.open_loops, r.people, r.evidence) for r in got} == rows
    for p in (1, 2):
        order = sorted((r for r in got if r.package_id == p), key=lambda r: r.rank)
        keys = [(-r.decisions - r.open_loops, -r.claims, r.label, r.area) for r in order]
        assert keys == sorted(keys) and [r.rank for r in order] == list(range(1, len(order) + 1))
    assert areas.coverage_areas(c.limit(0), e).count() == 0 and areas.coverage_areas(c, e.limit(0)).count() > 0


def test_positions_are_shuffled_once_by_text(spark):
    """Neither all words of the texts nor the places expanded by query and block go through a shuffle."""
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "a fox and a red hen")], "id long, text string")
    asked = spark.createDataFrame([(7, "red fox"), (8, "hen -runs")], "query_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.web_search(docs, asked, stems=False)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(word#\d+, \d+\)|hashpartitioning\([^)]*block#", plan)
        assert [(r.query_id, r.id, r.rank) for r in found.orderBy("query_id", "rank").collect()] == [(7, 1, 1), (7, 2, 2), (8, 2, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_texts_are_matched_in_their_task(spark):
    """One shuffle by text; no row of a text and a query is shuffled or joined again before the ranks."""
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "a fox and a red hen"), (None, "red fox")], "id long, text string")
    asked = spark.createDataFrame([(7, "red fox"), (8, "hen -runs"), (9, "-fox")], "query_id long, text string")
    found = search.web_search(docs, asked, stems=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id#") == 1 and "collect_set" not in plan and "SortMergeJoin" not in plan
    assert {(r.query_id, r.id) for r in found.collect()} == {(7, 1), (7, 2), (7, None), (8, 2)}


def test_matching_does_not_depend_on_the_batches(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    queries = spark.createDataFrame([(1, "w1 w2"), (2, '"w1 w2 w3"'), (3, "w1 or w4 -w5"), (4, "-w2"), (5, 'w6 "w2 w2"')], "query_id long, text string")
    matcher = search.Matcher(search.literals(queries).withColumnRenamed("word", "term").toArrow())
    rows = sorted((i, rng.choice([-1, *range(len(matcher.terms))]), rng.randrange(300)) for i in range(300) for _ in range(rng.choice([1, 3, 40])))
    table = pa.table({"id": [r[0] for r in rows], "code": pa.array([r[1] for r in rows], pa.int32()), "pos": pa.array([r[2] for r in rows], pa.int32())})
    answer = lambda n: sorted((r["query_id"], r["id"], round(r["score"], 9)) for b in matcher.run(iter(table.to_batches(max_chunksize=n))) for r in b.to_pylist())
    want = answer(10_000)
    monkeypatch.setattr(search, "PLACES", 50)
    assert len(want) > 100 and answer(7) == want
    alone = [r for i in range(300) for b in matcher.run(iter(table.filter(pa.array([x[0] == i for x in rows])).to_batches())) for r in b.to_pylist()]
    assert sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in alone) == want


def test_vector_search_meets_in_blocks_and_keeps_its_order(spark):
    from threadloom.operators import retrieval

    import numpy as np

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(3_000, 6)), 1).tolist()
    v[7], v[8], v[9], v[10] = None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]
    for copy in range(100, 1_200):  # more copies than any list holds
        v[copy] = v[2]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    few = docs.where("id % 50 = 2 or id = 7").selectExpr("id as query_id", "v as q")

    def scores(q):
        out = []
        for i, x in enumerate(v):
            usable = all(y is not None and None not in y and any(y) for y in (q, x)) and len(q) == len(x)
            s = round(float(np.dot(q, x) / (np.linalg.norm(q) * np.linalg.norm(x))), 4) if usable else None
            out.append((s is None, -(s or 0.0), i, s))
        return [(i, s) for _, _, i, s in sorted(out)[:5]]

    want = {(i, rank, *hit) for i in range(len(v)) if i % 50 == 2 or i == 7 for rank, hit in enumerate(scores(v[i]), 1)}
    for at_once, block in ((16_384, 131_072), (7, 250)):
        found = retrieval.vector_search(docs, few, 5, at_once=at_once, block=block)
        assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_text_search_shuffles_words_once(spark):
    from threadloom.operators import retrieval

    docs = spark.createDataFrame([(1, "red fox red"), (1, "red hen"), (2, None), (3, ""), (4, "blue whale and more words"), (5, "fox")], "id long, text string")
    found = retrieval.text_search(docs, spark.createDataFrame([(9, "red fox"), (8, "whale")], "query_id long, text string"))
    n, avg, idf = 5, 11 / 5, lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda df, tf, size: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))
    # the two texts of id 1 have postings of their own, as their lengths differ
    want = {(9, 1, round(part(2, 2, 3) + part(2, 1, 3) + part(2, 1, 2), 4)), (9, 5, round(part(2, 1, 1), 4)), (8, 4, round(part(1, 1, 5), 4))}
    assert {(r["query_id"], r["id"], r["score"]) for r in found.collect()} == want and n == 5
    final = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in final.split("Initial Plan")[0]
