"""Communities, neighbours, greedy matching and agreement of clusterings against plain Python."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import clustering, communities, neighbours, report


def quality(edges, of, gamma=1.0):
    total, inside, degree = 0.0, 0.0, defaultdict(float)
    for a, b, w in edges:
        total += 2 * w
        inside += 2 * w * (of[a] == of[b])
        degree[of[a]] += w
        degree[of[b]] += w
    return inside / total - gamma * sum((k / total) ** 2 for k in degree.values())


def connected(edges, of):
    near = defaultdict(set)
    for a, b, _ in edges:
        if of[a] == of[b]:
            near[a].add(b)
            near[b].add(a)
    groups = defaultdict(set)
    for node, c in of.items():
        groups[c].add(node)
    for group in groups.values():
        seen, todo = set(), [min(group)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        if seen != group:
            return False
    return True


def planted(seed, groups=6, size=12, inner=0.6, outer=0.03):
    rng = random.Random(seed)
    nodes = list(range(groups * size))
    rng.shuffle(nodes)
    of = {x: i // size for i, x in enumerate(nodes)}
    edges = [(a, b, rng.choice([1.0, 0.5])) for a, b in itertools.combinations(sorted(of), 2) if rng.random() < (inner if of[a] == of[b] else outer)]
    return of, edges


def found_by(spark, edges, **options):
    df = spark.createDataFrame(edges, "a long, b long, w double")
    return {r.node: r.community for r in communities.leiden(df, **options).collect()}


def test_leiden_finds_planted_groups(spark):
    of, edges = planted(1, 4, 10)
    got = found_by(spark, edges)
    groups = defaultdict(set)
    for node, c in got.items():
        groups[c].add(node)
    want = defaultdict(set)
    for node, c in of.items():
        want[c].add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(g) for c, g in groups.items())
    df = spark.createDataFrame(edges, "a long, b long, w double")
    row = communities.modularity(df, spark.createDataFrame(list(got.items()), "node long, community long")).first()
    assert row.communities == 4 and abs(row.modularity - quality(edges, got)) < 1e-6
    assert found_by(spark, edges[::-1]) == got  # reruns and other orders agree


def test_leiden_on_a_noisy_graph(spark):
    rng = random.Random(7)
    edges = [(a, b, round(rng.random(), 3) + 0.001) for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.12]
    got = found_by(spark, edges)
    assert connected(edges, got)
    best = quality(edges, got)
    # as good as greedy moves of single nodes from single nodes, and no move of a single node gains
    for node in got:
        for c in set(got.values()):
            assert quality(edges, got | {node: c}) <= best + 1e-5
    assert best > 0.3


def test_a_round_never_lowers_the_quality(spark, monkeypatch):
    of, edges = planted(3, 4, 8, 0.7, 0.1)
    seen = []
    moved = communities._moved

    def watched(nodes, accepted):
        out = moved(nodes, accepted)
        seen.append(out)
        return out

    monkeypatch.setattr(communities, "_moved", watched)
    links = communities.staged(communities.both_ways(spark.createDataFrame(edges, "a long, b long, w double")))
    nodes = communities.staged(links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")))
    monkeypatch.setattr(communities, "discard", lambda *tables: None)
    total = nodes.agg(F.sum("k")).first()[0]
    assert communities.local_moves(nodes, links, 1 / total)[1]
    values = [quality(edges, {r.node: r.c for r in x.collect()}) for x in seen]
    assert len(values) > 1 and values == sorted(values)


def test_leiden_edge_cases(spark):
    assert found_by(spark, []) == {}
    odd = [(1, 1, 5.0), (None, 2, 1.0), (3, 4, 0.0), (5, 6, 1.0), (6, 5, 1.0), (7, 8, -1.0)]
    alone = spark.createDataFrame([(9,), (5,), (None,)], "node long")
    assert found_by(spark, odd, nodes=alone) == {5: 5, 6: 5, 9: 9}
    star = [(0, i, 1.0) for i in range(1, 30)]
    got = found_by(spark, star)
    assert connected(star, got) and set(got) == set(range(30))
    assert found_by(spark, [(1, 2, 1.0), (3, 4, 1.0), (2, 3, 0.01)], gamma=0.0) == {1: 1, 2: 1, 3: 1, 4: 1}


def test_small_groups_are_settled_in_tasks(spark, monkeypatch):
    """Cliques in a chain take two looks at the whole graph, one of them at the contracted one, and no round."""
    edges = [(9 * c + i, 9 * c + j, 1.0) for c in range(30) for i, j in itertools.combinations(range(6), 2)] + [(9 * c, 9 * c + 9, 0.05) for c in range(29)]
    looks, plain = [], communities.staged
    monkeypatch.setattr(communities, "staged", lambda df, name: looks.append(name) or plain(df, name))
    assert found_by(spark, edges, gamma=10.0) == {9 * c + i: 9 * c for c in range(30) for i in range(6)}
    assert looks.count("wanted") <= 2


def test_settled_groups_with_many_edges_are_left_to_the_rounds(spark, monkeypatch):
    of, edges = planted(5, 3, 8)
    monkeypatch.setattr(communities, "TASK_EDGES", 10)
    got = found_by(spark, edges)
    assert connected(edges, got) and len(set(got.values())) == 3


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(20, 24))[rng.integers(0, 20, 1500)] + 0.6 * rng.normal(size=(1500, 24))
    v[1400:1460] = v[3]  # copies
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24)], "id long, v array<double>").cache()


def by_cosine(v, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 6)
    return {(i, j) for i in range(len(v)) for j in sorted((j for j in range(len(v)) if j != i), key=lambda j: (-near[i, j], j))[:k]}


def test_neighbours(cloud):
    v, df = cloud
    want = by_cosine(v[:300], 7)
    exact = neighbours.nearest(df.where("id < 300 or id >= 2000"), 7, cells=1, chunk=50)
    assert {(r.id, r.other) for r in exact.collect()} == want
    want = by_cosine(v, 10)
    got = {(r.id, r.other) for r in neighbours.nearest(df, 10, chunk=64).collect()}
    assert len(got & want) >= 0.9 * len(want) and all(i != j for i, j in got)
    assert neighbours.nearest(df.limit(0), 3).count() == 0


def test_scored_pairs(spark):
    people = "array<struct<member: long, weight: double>>"
    rows = [(1, [(1, 2.0), (2, 1.0)], [1.0, 0.0], ["a", "b"], [1], 0, 100), (2, [(2, 1.0), (3, 1.0)], [0.6, 0.8], ["b"], [1, 2], 50, 150), (3, None, [-1.0, 0.0], [], None, 86_400 * 14 + 100, 86_400 * 14 + 100)]
    features = spark.createDataFrame(rows, f"id long, participants {people}, v array<double>, keywords array<string>, links array<long>, start long, end long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "a long, b long")
    got = {(r.a, r.b): r.w for r in neighbours.scored_pairs(pairs, features).collect()}
    assert got[1, 2] == pytest.approx(0.35 / 4 + 0.30 * 0.6 + 0.20 + 0.10 * 50 / 150 + 0.05 / 2)
    assert got[1, 3] == pytest.approx(0.10 * 0.3 * np.exp(-1)) and len(got) == 2


def greedy(new, old, least=0.5):
    used, out = set(), {}
    for n in sorted(new):
        best, best_j = None, 0.0
        for o in sorted(old):
            j = len(new[n] & old[o]) / len(new[n] | old[o])
            if o not in used and j > best_j:
                best, best_j = o, j
        if best is not None and best_j >= least:
            used.add(best)
            out[n] = best
    return out


def test_carry_over_is_greedy(spark):
    frame = lambda sets: spark.createDataFrame([(i, c) for c, items in sets.items() for i in items] or [(None, None)], "item long, community long")
    new, old = {1: set(range(10)), 2: set(range(1, 11))}, {101: set(range(10)), 102: set(range(2, 10))}
    got = {r.new: r.old for r in clustering.carried_over(frame(new), frame(old)).collect()}
    assert got == {1: 101, 2: 102} == greedy(new, old)
    rng = random.Random(9)
    for _ in range(4):
        new, old = ({c + base: set(range(s, s + rng.choice([6, 7, 8]))) for c, s in enumerate(rng.choices(range(10), k=9))} for base in (1, 100))
        got = {r.new: r.old for r in clustering.carried_over(frame(new), frame(old)).collect()}
        assert got == greedy(new, old)
    assert clustering.carried_over(frame({}), frame(old)).count() == 0


def test_labels_go_to_all_that_are_like_it(spark):
    new = spark.createDataFrame([(i, 1) for i in range(10)] + [(i, 2) for i in range(1, 11)] + [(50, 3)], "item long, community long")
    own = spark.createDataFrame([(i, 7, "mine") for i in range(10)] + [(i, 6, "also") for i in range(4, 10)], "item long, community long, label string")
    assert {(r.new, r.label) for r in clustering.sticky_labels(new, own).collect()} == {(1, "mine"), (2, "mine")}


def overlapping(seed, n=40):
    rng = random.Random(seed)
    return {i: set(rng.sample(range(5), rng.choice([0, 1, 1, 2]))) for i in range(n)}


def test_agreement_of_overlapping_clusterings(spark):
    frame = lambda sets: spark.createDataFrame([(i, c) for i, cs in sets.items() for c in cs] + [(0, None), (None, 1)], "item long, cluster long")
    gold, pred = overlapping(1), overlapping(2)
    items = [i for i in gold if gold[i] or pred[i]]
    p = r = 0.0
    for x in items:
        mp = [(len(pred[x] & pred[y]), len(gold[x] & gold[y])) for y in items]
        own = [min(a, b) / a for a, b in mp if a]
        theirs = [min(a, b) / b for a, b in mp if b]
        p += sum(own) / len(own) if own else 0
        r += sum(theirs) / len(theirs) if theirs else 0
    p, r = p / len(items), r / len(items)
    got = report.extended_bcubed(frame(pred), frame(gold)).first()
    assert (got.precision, got.recall) == pytest.approx((p, r), abs=1e-6) and got.f1 == pytest.approx(2 * p * r / (p + r), abs=1e-6)
    want = defaultdict(int)
    for x, y in itertools.combinations(items, 2):
        want[len(pred[x] & pred[y]), len(gold[x] & gold[y])] += 1
    want.pop((0, 0))
    assert {(r.x, r.y): r.n for r in report.both_pairs(frame(pred), frame(gold)).collect()} == want
    none = frame({})
    assert report.extended_bcubed(none, none).first().f1 == 0 and report.omega_index(none, none).first().omega == 1


def test_one_large_cluster(spark):
    """A cluster of a million items is a row, not 5e11 pairs."""
    one = spark.range(1_000_000).select(F.col("id").alias("item"), F.lit(1).alias("cluster"))
    halves = spark.range(1_000_000).select(F.col("id").alias("item"), (F.col("id") % 2).alias("cluster"))
    row = report.pairwise_f1(one, halves).first()
    assert row.tp == 2 * (500_000 * 499_999 // 2) and row.fp == 500_000**2 and row.fn == 0
    assert report.extended_bcubed(one, halves).first().precision == pytest.approx(0.5) and report.omega_index(one, halves).first().omega == pytest.approx(0)


def test_best_of_tiles_against_brute_force(monkeypatch):
    """Large sides are compared piece by piece; what ties with the k-th stays."""
    import numpy as np
    from threadloom.operators import neighbours

    monkeypatch.setattr(neighbours, "STRIP", 7)
    monkeypatch.setattr(neighbours, "TILE", 10)
    x = np.random.default_rng(2).integers(-1, 2, (41, 4)) / 2.0
    for y, same in ((x, True), (x[:33] + 0.0, False), (x[:3], False)):
        got = {(p, q): s for a, b, t in neighbours._best(x, y, 5, 6, same) for p, q, s in zip(a.tolist(), b.tolist(), t.tolist())}
        near = np.round(x @ y.T, 6)
        if same:
            np.fill_diagonal(near, -9)
        bound = -np.sort(-near, axis=1)[:, min(5, len(y)) - 1]
        assert got == {(p, q): near[p, q] for p, q in zip(*(z.tolist() for z in np.nonzero((near >= bound[:, None]) & (near > -9))))}


def test_meetings_of_everything_are_few(spark, monkeypatch):
    """A vector is sent to eight meetings, not to one for every 512 vectors."""
    from threadloom.operators import neighbours

    dealt, deal = [], neighbours.split_groups
    monkeypatch.setattr(neighbours, "split_groups", lambda df, *a: dealt.append(deal(df, *a)) or dealt[-1])
    vectors = spark.range(6_000).selectExpr("id", "array(1.0, cast(id as double)) as v")
    neighbours.nearest(vectors, 3, cells=1)
    assert dealt[0].count() == 8 * 6_000


def test_candidates_of_both_kinds_come_once_without_a_shuffle_of_the_rare_pairs(spark):
    from threadloom.operators import groups

    members = spark.createDataFrame([(t, m) for t in range(40) for m in (t % 4, 10 + t % 7, None)] + [(None, 3)], "group_id long, member long")
    vectors = spark.createDataFrame([(t, [float(t % 5 + 1), float(t % 3), 1.0]) for t in range(45)], "id long, v array<double>")
    got = [(r.a, r.b) for r in neighbours.candidate_pairs(members, vectors, 3, cells=1).collect()]
    near = {tuple(sorted((r.id, r.other))) for r in neighbours.nearest(vectors, 3, cells=1).collect()}
    shared = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 == b % 4 or a % 7 == b % 7}
    assert near & shared and near - shared and len(got) == len(set(got)) and set(got) == near | shared
    sums = groups.pair_sums
    try:
        clustering.copresence.__globals__["pair_sums"] = lambda rows, **_: rows.sparkSession.range(1_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("total"))
        plan = neighbours.candidate_pairs(members, vectors, 3, cells=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        clustering.copresence.__globals__["pair_sums"] = sums
    # the pairs of rare participants go out as they are made
    assert "Union" in plan.split("Exchange")[0]


def test_packed_tables_are_not_broadcast_for_the_size_of_their_files(spark, tmp_path):
    from threadloom.plans import graphs
    from threadloom.session import BROADCAST_ROWS, staged

    rows = staged(spark.range(BROADCAST_ROWS + 1).select(F.col("id").alias("node"), (F.col("id") % 3).alias("c")), "many")
    few = staged(spark.range(50).select(F.col("id").alias("node")), "few")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(rows.join(rows.groupBy("c").agg(F.max("node").alias("node")), "node"))
    assert "BroadcastHashJoin" in plan(few.join(few.withColumn("x", F.lit(1)), "node"))
    spark.range(400).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = graphs.line_graph(spark, str(tmp_path))[1]
    assert "BroadcastHashJoin" not in plan(edges) and edges.count() == 100 * 6 + 99


def test_scored_pairs_meet_in_blocks_and_are_shuffled_as_ids(spark):
    rng = random.Random(4)
    people = "array<struct<member: long, weight: double>>"
    some = lambda values: rng.choice([None, [], rng.sample(values, 2), rng.sample(values, 4)])
    row = lambda i: (i, some([(m, 0.5 + m) for m in range(9)]), rng.choice([None, [0.6, 0.8], [1.0, 0.0], [-1.0, 0.0], [1.0]]), some(list("abcdef") + [None]), some(list(range(8))), rng.choice([None, i, 3 * i]), 4 * i + 5)
    rows = [row(i) for i in range(60)] + [row(7)]
    features = spark.createDataFrame(rows, f"id long, participants {people}, v array<double>, keywords array<string>, links array<long>, start long, end long")
    pairs = spark.createDataFrame([(a, b) for a in range(62) for b in range(a + 1, 62) if (a * b) % 3], "a int, b int")

    def weight(x, y):
        p, q = set(x[1] or []), set(y[1] or [])
        w = lambda s: sum(m[1] for m in s)
        alike = w(p & q) / w(p | q) if p | q else 0
        near = max(0.0, sum(i * j for i, j in zip(x[2], y[2]))) if x[2] and y[2] and len(x[2]) == len(y[2]) else 0
        (k, o), (m, r) = (set(x[3] or []), set(y[3] or [])), (set(x[4] or []), set(y[4] or []))
        starts, ends = [t for t in (x[5], y[5]) if t is not None], (x[6], y[6])
        time = 0
        if starts:
            both, union = min(ends) - max(starts), max(ends) - min(starts)
            time = both / union if both > 0 else 0.3 * np.exp(-((-both / (86_400 * 14)) ** 2))
        return 0.35 * alike + 0.3 * near + 0.2 * (len(k & o) / min(len(k), len(o)) if k and o else 0) + 0.1 * time + 0.05 * (len(m & r) / len(m | r) if m | r else 0)

    want = sorted((x[0], y[0], round(weight(x, y), 9)) for x in rows for y in rows if x[0] < y[0] and (x[0] * y[0]) % 3)
    scored = neighbours.scored_pairs(pairs, features, chunk=7)
    got = sorted((r.a, r.b, round(r.w, 9)) for r in scored.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert neighbours.scored_pairs(pairs, features.limit(0)).count() == 0 == neighbours.scored_pairs(pairs.limit(0), features).count()
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()  # no pair carries features through a join
